"""Source divergence audit: how far each source's words lie from those of the others and of its language.

Terms are counted where they are read and move as counts. Pairs of sources are summed sparsely: a term that
neither has adds the difference of their baselines (the share of a count of 0), so all terms are taken at
that, and corrected for those that one or both have. Shares below the highest baseline are few distinct values and
are summed from a histogram of them; terms of both come from a join of a term's sources.

The first terms of a group are found by radix selection: histograms over the bits of the values, leading bits first, give
the digit in which the k-th lies; what is above is in, what is below is out, what is in that digit goes on. Ties
that remain go on over their UTF-8 bytes. No group is ordered as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwork.llm.line_dedup import lower_ascii
from siftwork.llm.skew import dealt_join
from siftwork.session import stored, table

#: Fixed value: what stands between terms.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Shares are parts of SCALE; every count is raised by PRIOR.
SCALE, PRIOR = 1_000_000_000, 5
#: Bits and bytes of a digit of the selection; the first digit is a value's bit length and so many leading bits.
BITS, BYTES, LEADING = 16, 2, 10
#: Copies of the groups of a language, so that its rows are spread.
SALTS = 32
GROUP = ["lang", "source"]


def share(count: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)), exact at any count; null without terms."""
    return F.expr(
        f"cast({count} + {PRIOR} as decimal(20,0)) * cast({SCALE} as decimal(10,0)) div cast(nullif({total} + {PRIOR} * {terms}, 0) as decimal(20,0)) + 1"
    )


def _code(name: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), name)


def group_codes(names: DataFrame) -> DataFrame:
    """(lang_name, source_name, lang, source, seed): 64-bit codes for languages and sources, by which all counting goes; the seed is one for which no two names have one code."""
    names, seed = stored(names), 0
    while True:
        coded = names.select("*", _code(F.col("lang_name"), seed).alias("lang"), _code(F.col("source_name"), seed).alias("source"), F.lit(seed).alias("seed"))
        double = [coded.groupBy(c).agg(F.count_distinct(f"{c}_name").alias("n")).filter("n > 1").select("n") for c in GROUP]
        if double[0].union(double[1]).isEmpty():
            return coded
        seed += 1


def term_counts(docs: DataFrame, lang: Column, source: Column, text: Column) -> DataFrame:
    """(lang, source, term, c, d): occurrences and documents of each term. lang and source may be codes."""
    terms = F.sort_array(F.split(lower_ascii(text), BETWEEN))
    marked = F.transform("t", lambda x, i: F.struct(x.alias("term"), (i == 0) | (F.get("t", i - 1) != x)))
    return (
        docs.select(lang.alias("lang"), source.alias("source"), terms.alias("t"))
        .select(*GROUP, F.explode(marked).alias("x"))
        .filter("x.term <> ''")
        .groupBy(*GROUP, F.col("x.term").alias("term"))
        .agg(F.count(F.lit(1)).alias("c"), F.count(F.when(F.col("x.col2"), 1)).alias("d"))
    )


def _length(value: str) -> Column:
    """Number of bits of a value."""
    return F.when(F.col(value) == 0, 0).otherwise(F.length(F.bin(value))).cast("int")


def _leading(value: str) -> Column:
    """A digit by which greater values come first: bit length, then leading bits. Small and great values are told apart alike."""
    n = _length(value)
    top = F.call_function("shiftright", F.col(value), F.greatest(n - LEADING, F.lit(0))).cast("int")
    return F.lit(1 << 20) - (n * F.lit(1 << LEADING) + top)


def first_ranked(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k first rows of each group by value, largest first, ties by item in UTF-8 order; with rank from 1.

    rows: keys, value (a long, not negative) and item, no item twice in a group.
    """
    live = stored(rows.select(*keys, "value", "item", F.lit(k).cast("long").alias("need")))
    bits = (live.agg(F.max("value")).first()[0] or 0).bit_length()
    values, low = [_leading("value")], F.col("value").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(_length("value") - LEADING, F.lit(0))) - 1)
    for shift in reversed(range(0, max(bits - LEADING, 0), BITS)):
        values.append(F.lit((1 << BITS) - 1) - F.shiftright(low, shift).bitwiseAND((1 << BITS) - 1))
    sure, turn = [], 0
    while True:
        at = (turn - len(values)) * BYTES + 1
        digit = values[turn] if turn < len(values) else F.substring(F.encode("item", "UTF-8"), at, BYTES)
        live, turn = live.withColumn("digit", digit), turn + 1
        counts = live.groupBy(*keys, "digit").agg(F.count(F.lit(1)).alias("n"), F.max("need").alias("need"))
        counts = counts.withColumn("before", F.sum("n").over(Window.partitionBy(*keys).orderBy("digit")) - F.col("n"))  # 2**16 digits at most
        last = F.max_by(F.struct("digit", "n", "before", "need"), F.when(F.col("before") < F.col("need"), F.col("digit")))
        cut = counts.groupBy(*keys).agg(last.alias("x"), F.sum("n").alias("total"))
        left = F.col("x.need") - F.col("x.before")
        cut = stored(cut.select(*keys, "total", F.col("x.digit").alias("at"), left.alias("left"), (F.col("x.n") <= left).alias("all")))
        met = dealt_join(live.drop("need"), cut, keys, "total").filter("digit <= at")
        met = stored(met.select(*keys, "value", "item", F.col("left").alias("need"), (F.col("all") | (F.col("digit") < F.col("at"))).alias("sure")))
        sure.append(met.filter("sure").select(*keys, "value", "item"))
        live = met.filter("NOT sure").drop("sure")
        if live.isEmpty():
            break
    out = sure[0]
    for more in sure[1:]:
        out = out.unionByName(more)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("value"), "item"))  # k rows a group
    return out.select(*keys, "value", "item", place.alias("rank"))


def _with_others(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of sources, each with the other sources of its language, as item and item_z. A language's rows are spread."""
    others = groups.select("lang", F.col("source").alias("item"), F.col("z").alias("item_z")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(*[c for c in rows.columns if c != "lang"]), F.lit(SALTS)).cast("int"))
    return dealt.join(others, ["lang", "salt"]).filter("source <> item").drop("salt")


def pair_sums(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the sum of the differences of all kept terms' shares, for each two sources of a language."""
    sums = shares.groupBy(*GROUP).agg(F.sum("p").alias("sp"))
    sources = groups.join(sums, GROUP, "left").withColumn("sp", F.coalesce("sp", F.lit(0).cast("long")))
    gap = F.abs(F.col("z") - F.col("item_z"))
    base = _with_others(sources.select(*GROUP, "held", "sp", "z", "v"), groups)
    alone = F.col("sp") - F.col("held") * F.col("item_z") - F.col("held") * gap
    base = base.select(*GROUP, "item", (alone + F.when(F.col("source") < F.col("item"), F.col("v") * gap).otherwise(0)).alias("value"))
    low = shares.filter("p < top").groupBy(*GROUP, "p").agg(F.count(F.lit(1)).alias("n"))
    low = _with_others(low, groups).filter("p < item_z").select(*GROUP, "item", (2 * F.col("n") * (F.col("item_z") - F.col("p"))).alias("value"))
    a = shares.select("lang", "term", "source", "p", "z")
    b = shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("item_p"), F.col("z").alias("item_z"))
    both = F.abs(F.col("p") - F.col("item_p")) - F.abs(F.col("p") - F.col("item_z")) - F.abs(F.col("item_p") - F.col("z")) + gap
    both = a.join(b, ["lang", "term"]).filter("source < item").select(*GROUP, "item", both.alias("value"))
    parts = base.unionByName(low).unionByName(both)
    parts = parts.select("lang", F.least("source", "item").alias("x"), F.greatest("source", "item").alias("y"), "value")
    total = parts.groupBy("lang", "x", "y").agg(F.sum("value").alias("value"))
    ways = F.array(F.struct(F.col("x").alias("source"), F.col("y").alias("item")), F.struct(F.col("y").alias("source"), F.col("x").alias("item")))
    return total.select("lang", F.explode(ways).alias("w"), "value").select("lang", "w.source", "w.item", "value")


def source_divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = 30, top: int = 50) -> DataFrame:
    """How each source's terms differ from those of its language and of the language's other sources.

    Returns lang, source, part, item, value and rank. Part pair: item is each other source of the language, value
    the sum of the differences of shares over all kept terms. Part term: item is a term of which the source has a larger
    share than its language, value by how much; the first top of them. Ranks go by value, largest first, then item.

    A language keeps the terms that min_docs of its documents hold, each row being a document, repeated
    ones too. Null languages, sources and texts are empty; a source without terms has every share at its baseline. Other
    columns of the input are not read. An empty table gives no rows.
    """
    lang, source, text = (F.coalesce(F.col(c), F.lit("")) for c in (lang_col, source_col, text_col))
    names = group_codes(docs.select(lang.alias("lang_name"), source.alias("source_name")).distinct())
    seed = names.first()
    lang, source = _code(lang, seed["seed"] if seed else 0), _code(source, seed["seed"] if seed else 0)
    counts = stored(term_counts(docs, lang, source, text))
    kept = counts.groupBy("lang", "term").agg(F.sum("c").alias("lc"), F.sum("d").alias("ld")).filter(F.col("ld") >= min_docs)
    kept = stored(kept.select("lang", "term", "lc"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lc").alias("ln"))
    own = stored(counts.join(kept, ["lang", "term"]).select(*GROUP, "term", "c", "lc"))
    present = own.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("held"), F.sum("c").alias("n"))
    groups = names.select(*GROUP).join(present, GROUP, "left").join(langs, "lang", "left")
    groups = groups.fillna(0, ["held", "n", "v", "ln"]).withColumn("z", F.coalesce(share("0", "n", "v"), F.lit(0).cast("long")))
    groups = stored(groups.withColumn("top", F.max("z").over(Window.partitionBy("lang"))))
    shares = dealt_join(own, groups.filter("held > 0"), GROUP, "held")
    shares = stored(shares.select(*GROUP, "term", share("c", "n", "v").alias("p"), share("lc", "ln", "v").alias("q"), "z", "top"))
    terms = first_ranked(shares.filter("p > q").select(*GROUP, (F.col("p") - F.col("q")).alias("value"), F.col("term").alias("item")), GROUP, top)
    pairs = pair_sums(shares, groups).withColumnRenamed("item", "other")
    pairs = pairs.join(names.select("lang", F.col("source").alias("other"), F.col("source_name").alias("item")), ["lang", "other"])
    place = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item"))
    pairs = pairs.select(*GROUP, "item", "value", place.alias("rank"), F.lit("pair").alias("part"))
    out = pairs.unionByName(terms.withColumn("part", F.lit("term"))).join(names, GROUP)
    return out.select(F.col("lang_name").alias("lang"), F.col("source_name").alias("source"), "part", "item", "value", "rank")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents."""
    return source_divergence(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), words AS (
  SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS lc FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 30
), langs AS (
  SELECT l.lang, count(k.term) AS v, coalesce(sum(k.lc), 0)::HUGEINT AS ln
  FROM (SELECT DISTINCT lang FROM docs) l LEFT JOIN kept k ON k.lang = l.lang GROUP BY l.lang
), counts AS (
  SELECT w.lang, w.source, w.term, count(*) AS c FROM words w JOIN kept k ON k.lang = w.lang AND k.term = w.term GROUP BY w.lang, w.source, w.term
), totals AS (
  SELECT g.lang, g.source, coalesce(sum(c.c), 0)::HUGEINT AS n
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
         1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 5)) // (g.n + 5 * l.v) AS p,
         1 + (1000000000::HUGEINT * (k.lc + 5)) // (l.ln + 5 * l.v) AS q
  FROM totals g JOIN langs l ON l.lang = g.lang JOIN kept k ON k.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM totals a JOIN totals b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM shares WHERE c > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM parts
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""
