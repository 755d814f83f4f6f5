"""Repair of conversations by error-correcting Earley parsing.

The grammar of roles is left-linear, so that every item of a chart begins at the start and a chart set holds
four completed symbols at most: E (nothing yet), S -> E system, U -> E user | S user | A user, A -> U assistant; E
and A are complete conversations. Weighted productions correct errors: a row is kept for its role, taken for
another (rerole), or skipped (delete), and a user or assistant turn is made from nothing (insert).

A symbol of a chart set keeps its least (cost, audit). Audits are compared without being built: those that end in
the row just read are numbered in their order, and links lead back through the sets. That is exact: no such audit
begins another of the same cost.

A conversation of more than LARGE rows is parsed in blocks at the same time, each from every symbol; a block
then is a table of costs and audit numbers from symbol to symbol, and tables are combined in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwork.llm.line_dedup import STRIP
from siftwork.llm.skew import dealt_join
from siftwork.llm.words import arrow_rows
from siftwork.session import cut, stored, table

#: Rows of a conversation that one task parses at once; the rows of a block of a larger one.
LARGE = 20_000
#: Costs of the productions, and of keeping a row that breaks off.
RENAME, DELETE, INSERT, BROKEN = 2, 3, 2, 1
#: (symbol, role that may follow by its initial, symbol then).
RULES = (("E", "s", "S"), ("E", "u", "U"), ("S", "u", "U"), ("A", "u", "U"), ("U", "a", "A"))
SYMBOLS, COMPLETE, ROLES = "ESUA", "EA", {"u": "user", "a": "assistant"}
AFTER = {x: tuple((t, y) for s, t, y in RULES if s == x) for x in SYMBOLS}
NEIGHBOURS = ("su", "ua", "au")

Item = tuple[int, int, int, str]  # cost, number of the audit up to the last row, inserts since, symbol after the last row
Set = dict[str, Item]


def with_inserts(items: Set) -> Set:
    """A chart set with all that insert productions add."""
    out, todo = dict(items), list(items)
    while todo:
        x = todo.pop()
        cost, number, made, origin = out[x]
        for role, y in AFTER[x]:
            new = (cost + INSERT, number, made + 1, origin)
            if role in ROLES and (y not in out or new < out[y]):
                out[y] = new
                todo.append(y)
    return out


def _scan(items: Set, cell: str) -> tuple[Set, dict[str, tuple[str, str]]]:
    """The next chart set, and for each symbol the symbol that it comes from and the audit's letters since.

    cell: d for a row that must go; else the role's initial, upper case if the row breaks off.
    """
    best: dict[str, tuple[int, tuple[int, str], str]] = {}
    for x, (cost, number, made, origin) in with_inserts(items).items():
        before = "I" * made
        offers = [(x, cost + DELETE, "D")]
        if cell != "d":
            own, kept = cell.lower(), cost + BROKEN * cell.isupper()
            for role, y in AFTER[x]:
                if role == own:
                    offers.append((y, kept, "K"))
                elif role in ROLES:
                    offers.append((y, kept + RENAME, "R"))
        for y, total, letter in offers:
            new = (total, (number, before + letter), origin)
            if y not in best or new < best[y]:
                best[y] = new
    place = {a: i for i, a in enumerate(sorted({v[1] for v in best.values()}))}
    return {y: (c, place[a], 0, y) for y, (c, a, _) in best.items()}, {y: (o, a[1]) for y, (_, a, o) in best.items()}


def chart(cells: str, start: str) -> tuple[Set, list[dict[str, tuple[str, str]]]]:
    """The last chart set, without inserts after the last row, and the links of all sets."""
    items, links = {start: (0, 0, 0, start)}, []
    for cell in cells:
        items, link = _scan(items, cell)
        links.append(link)
    return items, links


def trace(links: list[dict[str, tuple[str, str]]], end: str) -> str:
    out = []
    for link in reversed(links):
        end, letters = link[end]
        out.append(letters)
    return "".join(reversed(out))


def finish(items: Set) -> Item:
    """The cheapest complete conversation."""
    return min(v for x, v in with_inserts(items).items() if x in COMPLETE)


@lru_cache(maxsize=20_000)
def _short(cells: str) -> tuple[int, str]:
    items, links = chart(cells, "E")
    cost, _, made, end = finish(items)
    return cost, trace(links, end) + "I" * made


def parse(cells: str) -> tuple[int, str]:
    """(cost, audit) of a conversation."""
    return _short(cells) if len(cells) <= 64 else _short.__wrapped__(cells)


def apply(audit: str, rows: Iterator[tuple[str, str]], symbol: str = "E") -> Iterator[tuple[str, str]]:
    """The repaired (role, text) of a run of rows, from a symbol on."""
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter != "K":
            at = "a" if symbol == "U" else "u"
            role = ROLES[at]
        symbol = next(y for t, y in AFTER[symbol] if t == role[:1])
        yield role, text


TURNS = "array<struct<role:string,text:string>>"
REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
SCHEMA = f"conv string, block int, blocks int, turns {TURNS}, {REPORT}"
TURN_TYPE = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def _turns(rows: list[list[tuple[str, str]]]) -> pa.Array:
    return pa.array([[{"role": r, "text": t} for r, t in x] for x in rows], TURN_TYPE)


def _whole(key: str, rows: list[tuple]) -> tuple:
    """The result row of one conversation. rows: (turn, role, text, cell), in order."""
    seen, cells, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text, cell in rows:
        if cell == "d":
            n["blank"] += 1
        elif (role, text) in seen:
            n["duplicate"] += 1
            cell = "d"
        elif cell.isupper():
            n["truncated"] += 1
        seen.add((role, text))
        cells.append(cell)
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in NEIGHBOURS for a, b in zip(initials, initials[1:], strict=False))
    turns = {r[0] for r in rows if r[0] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    gaps = gaps if gaps < 2**63 else 0
    cost, audit = parse("".join(cells))
    return key, 0, 1, list(apply(audit, ((r[1], r[2]) for r in rows))), gaps, *n.values(), illegal, cost, audit


def _record(rows: list[tuple]) -> pa.RecordBatch:
    conv, block, blocks, turns, *report = zip(*rows, strict=True)
    names = [x.split()[0] for x in REPORT.split(", ")]
    columns = [pa.array(conv, pa.string()), pa.array(block, pa.int32()), pa.array(blocks, pa.int32()), _turns(list(turns))]
    columns += [pa.array(x, pa.string() if name == "audit" else pa.int64()) for name, x in zip(names, report, strict=True)]
    return pa.RecordBatch.from_arrays(columns, ["conv", "block", "blocks", "turns", *names])


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, held = None, []
    for batch in batches:
        out = []
        columns = [arrow_rows(batch, c).to_pylist() for c in ("conv", "turn", "role", "text", "cell")]
        for conv, turn, role, text, cell in zip(*columns, strict=True):
            if conv != key:
                if key is not None:
                    out.append(_whole(key, held))
                key, held = conv, []
            if cell:
                held.append((turn, role, text, cell))
        if out:
            yield _record(out)
    if key is not None:
        yield _record([_whole(key, held)])


# -- conversations of many rows, in blocks


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """((conv, block), rows of names) of sorted rows."""
    key, held = None, []
    for batch in batches:
        columns = [arrow_rows(batch, c).to_pylist() for c in ("conv", "block", *names)]
        for conv, block, *row in zip(*columns, strict=True):
            if (conv, block) != key:
                if key is not None:
                    yield key, held
                key, held = (conv, block), []
            held.append(tuple(row))
    if key is not None:
        yield key, held


PAIRS = [x + y for x in SYMBOLS for y in SYMBOLS]


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block: costs, audit numbers and audits from symbol to symbol; null where there is no way."""
    for (conv, block), rows in _runs(batches, ["cell"]):
        cells, costs, audits = "".join(c for (c,) in rows), {}, {}
        for start in SYMBOLS:
            items, links = chart(cells, start)
            for end, item in items.items():
                costs[start + end], audits[start + end] = item[0], trace(links, end)
        place = {a: i for i, a in enumerate(sorted(set(audits.values())))}
        one = [[conv], [block], [[costs.get(p) for p in PAIRS]], [[place.get(audits.get(p)) for p in PAIRS]], [[audits.get(p) for p in PAIRS]]]
        types = [pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(one, types, strict=True)], ["conv", "block", "costs", "places", "audits"])


def _combine(parts: pa.Table) -> pa.Table:
    """Of one conversation's block tables: each block's way from symbol to symbol, and the inserts after the last."""
    parts = parts.sort_by("block")
    items, links = {"E": (0, 0, 0, "E")}, []
    for costs, places in zip(parts["costs"].to_pylist(), parts["places"].to_pylist(), strict=True):
        best = {}
        for p, cost, place in zip(PAIRS, costs, places, strict=True):
            if cost is not None and p[0] in items:
                new = (items[p[0]][0] + cost, (items[p[0]][1], place), p[0])
                if p[1] not in best or new < best[p[1]]:
                    best[p[1]] = new
        number = {a: i for i, a in enumerate(sorted({v[1] for v in best.values()}))}
        items = {y: (c, number[a], 0, y) for y, (c, a, _) in best.items()}
        links.append({y: v[2] for y, v in best.items()})
    _, _, made, end = finish(items)
    ways = []
    for link in reversed(links):
        ways.append(link[end] + end)
        end = link[end]
    ways = ways[::-1]
    n = len(ways)
    return pa.table({"conv": parts["conv"], "block": parts["block"], "way": pa.array(ways, pa.string()), "made": pa.array([0] * (n - 1) + [made], pa.int32()), "blocks": pa.array([n] * n, pa.int32())})


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns of each block; the row that carries a block's audit comes first."""
    for (conv, block), rows in _runs(batches, ["role", "text", "audit", "way"]):
        audit, way = next((r[2], r[3]) for r in rows if r[2] is not None)
        turns = list(apply(audit, (r[:2] for r in rows if r[2] is None), way[0]))
        yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([block], pa.int32()), _turns([turns])], ["conv", "block", "turns"])


def _dealt(df: DataFrame, order: str) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, "conv", "block").sortWithinPartitions("conv", "block", order)


def _large(rows: DataFrame, n_rows: int) -> DataFrame:
    """Conversations of many rows: one result row a block, with the report in the first."""
    parts = max(1, -(-n_rows // LARGE) * 2)
    same = [F.xxhash64("conv", "role", "text").alias("h1"), F.xxhash64(F.lit(7), "conv", "role", "text").alias("h2")]
    apart = F.xxhash64(F.monotonically_increasing_id())  # equal rows, whose order doesn't matter, may lie in several blocks
    ordered = cut(
        rows.select("conv", "turn", "role", "text", "cell", *same).withColumn("apart", apart)
        .repartitionByRange(parts, "conv", F.col("turn").asc_nulls_first(), "role", "text", "apart")
        .sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text")
        .drop("apart")
    )
    seq = F.monotonically_increasing_id()  # a checkpoint keeps its partitions and their order
    ordered = ordered.withColumn("seq", seq).withColumn("block", F.shiftright("seq", 33).cast("int"))
    keys = ordered.select("h1", "h2", "seq", "cell")
    firsts = stored(keys.filter("cell <> 'd'").groupBy("h1", "h2").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    again = dealt_join(keys.select("h1", "h2", "seq"), firsts, ["h1", "h2"], "n").filter("seq <> first").select("seq", F.lit(True).alias("again"))
    narrow = ordered.select("seq", "conv", "block", "turn", F.substring("role", 1, 1).alias("initial"), "cell").join(again, "seq", "left")
    fault = F.when(F.col("cell") == "d", "blank").when(F.col("again"), "duplicate").when(F.col("cell") != F.lower("cell"), "truncated")
    narrow = stored(narrow.withColumn("fault", fault).withColumn("cell", F.when(F.col("again"), "d").otherwise(F.col("cell"))).drop("again"))
    tables = stored(_dealt(narrow.select("conv", "block", "seq", "cell"), "seq").mapInArrow(_tables, "conv string, block int, costs array<long>, places array<int>, audits array<string>"))
    ways = tables.select("conv", "block", "costs", "places").groupBy("conv").applyInArrow(_combine, "conv string, block int, way string, made int, blocks int")
    at = F.array_position(F.lit(PAIRS), F.col("way")).cast("int") - 1
    chosen = stored(
        tables.join(ways, ["conv", "block"])
        .select("conv", "block", "blocks", "way", F.concat(F.get("audits", at), F.repeat(F.lit("I"), F.col("made"))).alias("audit"), (F.get("costs", at) + INSERT * F.col("made")).alias("cost"))
    )
    ends = narrow.groupBy("conv", "block").agg(F.min_by("initial", "seq").alias("head"), F.max_by("initial", "seq").alias("tail"), F.min("seq").alias("seq"))
    edges = ends.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("block", "head", "tail"))).alias("e"))
    across = F.size(F.filter(F.transform("e", lambda x, i: (i > 0) & ~F.concat(F.get("e", i - 1)["tail"], x["head"]).isin(*NEIGHBOURS)), lambda x: x))
    follow = F.lag("initial").over(Window.partitionBy("conv", "block").orderBy("seq"))
    inside = narrow.withColumn("bad", F.coalesce(~F.concat(follow, "initial").isin(*NEIGHBOURS), F.lit(False)))
    report = inside.groupBy("conv").agg(
        *[F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")],
        F.count(F.when(F.col("bad"), 1)).alias("inside"), F.min("turn").alias("low"), F.max("turn").alias("high"),
    )
    distinct = narrow.select("conv", "turn").distinct().groupBy("conv").agg(F.count("turn").alias("turns_n"))
    audits = chosen.groupBy("conv").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), "").alias("audit"), F.sum("cost").alias("cost")
    )
    whole = report.join(distinct, "conv").join(audits, "conv").join(edges.select("conv", across.cast("long").alias("across")), "conv")
    whole = whole.select(
        "conv", F.coalesce(F.try_subtract(F.try_subtract("high", "low"), F.col("turns_n") - 1), F.lit(0)).alias("gaps"),
        "blank", "duplicate", "truncated", (F.col("inside") + F.col("across")).alias("illegal"), "cost", "audit",
    )
    audit_rows = chosen.select("conv", "block", F.lit(-1).cast("long").alias("seq"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "audit", "way")
    text_rows = ordered.select("conv", "block", "seq", "role", "text").withColumn("audit", F.lit(None).cast("string")).withColumn("way", F.lit(None).cast("string"))
    turns = _dealt(text_rows.unionByName(audit_rows), "seq").mapInArrow(_repaired, f"conv string, block int, turns {TURNS}")
    order = chosen.groupBy("conv").agg(F.min("block").alias("first"), F.max("blocks").alias("blocks"))
    joined = turns.join(order, "conv").join(whole.withColumnRenamed("conv", "c"), (F.col("conv") == F.col("c")) & (F.col("block") == F.col("first")), "left")
    return joined.select("conv", (F.col("block") - F.col("first")).alias("block"), "blocks", "turns", *[x.split()[0] for x in REPORT.split(", ")])


def conv_key(conv: Column) -> Column:
    """A conversation's id as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def repair_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", live: Column | None = None) -> DataFrame:
    """Faults, cheapest edits and repaired turns of conversations.

    Returns one row a conversation with conv (conv_key of its id), block 0, blocks 1, turns (the repaired roles and
    texts), gaps, blank, duplicate, truncated, illegal, cost and audit. A conversation of over LARGE rows gives a row
    for each of its blocks, in order, with its turns; the first has the report and the whole audit. Other
    columns of the input are left out, so that their names don't matter.

    Rows go by turn (nulls first), then role and text; equal rows are duplicates of each other. Null roles and texts
    are one space; rows of a null id are one conversation; gaps beyond a long are 0. live: rows for which it's false only say
    that the conversation exists; one without live rows has zeros, an empty audit and no turns.
    """
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (text_col, role_col))
    bare = F.btrim("text", F.lit(STRIP))
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    cell = F.when(bare == "", "d").when(F.right(bare, F.lit(1)).isin(".", "!", "?"), known).otherwise(F.upper(known))
    base = rows.select(
        conv_key(F.col(conv_col)).alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"),
        F.coalesce(live, F.lit(False)).alias("live") if live is not None else F.lit(True).alias("live"),
    )
    base = base.withColumn("cell", F.when(F.col("live"), cell)).drop("live")
    many = stored(base.filter("cell IS NOT NULL").groupBy("conv").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LARGE))
    total = many.agg(F.sum("n")).first()[0]
    small = base
    if total:  # many has rows / LARGE rows at most
        small = base.join(F.broadcast(many.select("conv")), "conv", "left_anti")
    order = ("conv", F.col("turn").asc_nulls_first(), "role", "text")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = small.repartition(parts, "conv").sortWithinPartitions(*order).mapInArrow(_small, SCHEMA)
    if total:
        out = out.unionByName(_large(base.filter("cell IS NOT NULL").join(F.broadcast(many.select("conv")), "conv", "left_semi"), total))
    return out


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of repaired conversations whose blocks stream by in order."""
    key, state, fresh = None, None, True
    out: list[tuple[str, str]] = []
    for batch in batches:
        for conv, turns in zip(arrow_rows(batch, "conv").to_pylist(), arrow_rows(batch, "turns").to_pylist(), strict=True):
            if conv != key:
                if key is not None:
                    out.append((key, state.hexdigest()))
                key, state, fresh = conv, hashlib.sha256(), True
            for t in turns:
                state.update(f"{'' if fresh else chr(10)}{t['role']}:{t['text']}".encode())
                fresh = False
    if key is not None:
        out.append((key, state.hexdigest()))
    conv, digest = zip(*out, strict=True) if out else ((), ())
    yield pa.RecordBatch.from_arrays([pa.array(conv, pa.string()), pa.array(digest, pa.string())], ["conv", "digest"])


def with_digests(repaired: DataFrame) -> DataFrame:
    """One row a conversation: its report, and digest, the SHA-256 of its turns as lines role:text.

    The hash of a conversation in blocks needs all of them one after the other: they stream through one task.
    """
    own = F.sha2(F.encode(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n"), "UTF-8"), 256)
    return repaired.filter("blocks = 1").withColumn("digest", own).drop("turns").unionByName(
        repaired.filter("block = 0 AND blocks > 1").drop("turns").join(
            repaired.filter("blocks > 1").select("conv", "block", "turns").repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(_hashed, "conv string, digest string"),
            "conv",
        )
    )


def damage(rows: DataFrame) -> DataFrame:
    """Rows of conversations with the faults of the contract, told by the CRC-32 of conv_id:turn, and column live."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    filled = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("code"))
    code = F.col("code")
    text = F.when(code == 1, "").when(code == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    twice = F.explode(F.when(code == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return filled.select("conv_id", "turn", F.when(code == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (code != 0).alias("live"), twice.alias("copy"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations, repaired; one digest row a conversation."""
    damaged = damage(table(spark, sf_dir, "conversations"))
    out = with_digests(repair_conversations(damaged, live=F.col("live")))
    conv = F.when(F.col("conv") != "", F.substr("conv", F.lit(2)).cast("long"))
    return out.select(conv.alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("digest").alias("repaired_sha256"))


ORACLE = """
WITH RECURSIVE bits AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) AS t
), coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
  FROM conversations
), hashed AS (
  SELECT c.*, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::BIGINT)),
                              lambda h, b: xor(h >> 8, bits.t[xor(h & 255, b) + 1])), 4294967295) % 20 AS code
  FROM coded c, bits
), damaged AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
         CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM hashed, unnest(CASE WHEN code = 3 THEN [0, 1] ELSE [0] END) AS u(copy) WHERE code <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
         lag(role[1]) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
         trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM damaged
), rows_ AS (
  SELECT conv_id, turn, n, role, text, role[1] AS initial, before || role[1] AS pair,
         CASE WHEN bare = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN bare[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) AS again FROM placed)
), edge(st, initial, role, nxt) AS (
  VALUES ('E', 's', 'system', 'S'), ('E', 'u', 'user', 'U'), ('S', 'u', 'user', 'U'), ('A', 'u', 'user', 'U'), ('U', 'a', 'assistant', 'A')
), ids AS (
  SELECT DISTINCT conv_id FROM conversations
), step AS (
  SELECT conv_id, 0::BIGINT AS n, 'E' AS st, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS rep FROM ids
  UNION ALL
  SELECT conv_id, n, st, cost, audit, rep FROM (
    WITH pre AS (
      SELECT * FROM step
      UNION ALL
      SELECT s.conv_id, s.n, e.nxt, s.cost + 2, s.audit || 'I', list_append(s.rep, e.role || ':') FROM step s JOIN edge e ON s.st = e.st AND e.initial <> 's'
    ), offers AS (
      SELECT p.conv_id, r.n, p.st, p.cost + 3 AS cost, p.audit || 'D' AS audit, p.rep
      FROM pre p JOIN rows_ r ON p.conv_id = r.conv_id AND r.n = p.n + 1
      UNION ALL
      SELECT p.conv_id, r.n, e.nxt, p.cost + (r.fault = 'truncated')::INT + CASE WHEN r.initial = e.initial THEN 0 ELSE 2 END,
             p.audit || CASE WHEN r.initial = e.initial THEN 'K' ELSE 'R' END,
             list_append(p.rep, CASE WHEN r.initial = e.initial THEN r.role ELSE e.role END || ':' || r.text)
      FROM pre p JOIN rows_ r ON p.conv_id = r.conv_id AND r.n = p.n + 1 AND r.fault NOT IN ('blank', 'duplicate')
      JOIN edge e ON p.st = e.st AND (r.initial = e.initial OR e.initial <> 's')
    )
    SELECT * FROM offers QUALIFY row_number() OVER (PARTITION BY conv_id, n, st ORDER BY cost, audit) = 1
  )
), last AS (
  SELECT i.conv_id, coalesce(max(r.n), 0) AS n FROM ids i LEFT JOIN rows_ r USING (conv_id) GROUP BY i.conv_id
), ended AS (
  SELECT s.* FROM step s JOIN last USING (conv_id, n)
), done AS (
  SELECT * FROM (
    SELECT * FROM ended
    UNION ALL
    SELECT s.conv_id, s.n, e.nxt, s.cost + 2, s.audit || 'I', list_append(s.rep, e.role || ':') FROM ended s JOIN edge e ON s.st = e.st AND e.initial <> 's'
  ) WHERE st IN ('E', 'A') QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows_ GROUP BY conv_id
)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit,
       sha256(array_to_string(rep, chr(10))) AS repaired_sha256
FROM done d LEFT JOIN counted c USING (conv_id)
"""
