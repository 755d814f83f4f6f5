"""Conversation repair against a search through all edits; the query's SQL is compared in test_llm."""

import hashlib
import heapq
import random

import pytest
from pyspark.sql import functions as F

from siftwork.llm import conversation_repair
from siftwork.llm.conversation_repair import apply, parse, repair_conversations, with_digests

STEP = {("E", "s"): "S", ("E", "u"): "U", ("S", "u"): "U", ("A", "u"): "U", ("U", "a"): "A"}


def search(cells):
    """(cost, audit) of the cheapest edits, by a search in the order of (cost, audit)."""
    heap, seen = [(0, "", 0, "E")], set()
    while heap:
        cost, audit, at, symbol = heapq.heappop(heap)
        if at == len(cells) and symbol in "EA":
            return cost, audit
        if (at, symbol, audit) in seen:
            continue
        seen.add((at, symbol, audit))
        for role in "ua":
            if (symbol, role) in STEP and audit.count("I") < 4:
                heapq.heappush(heap, (cost + 2, audit + "I", at, STEP[symbol, role]))
        if at < len(cells):
            cell = cells[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, symbol))
            for role in "sua" if cell != "d" else "":
                if (symbol, role) in STEP and (role == cell.lower() or role != "s"):
                    kept = role == cell.lower()
                    heapq.heappush(heap, (cost + cell.isupper() + (0 if kept else 2), audit + ("K" if kept else "R"), at + 1, STEP[symbol, role]))
    raise AssertionError


def test_parse_equals_search():
    r = random.Random(3)
    assert parse("") == (0, "") and parse("sua") == (0, "KKK") and parse("x") == (3, "D")
    for _ in range(400):
        cells = "".join(r.choice("ssuuuaaadSUAX") for _ in range(r.randrange(7)))
        assert parse(cells) == search(cells), cells


def test_long_ones_are_parsed_without_recursion():
    cells = "su" + "aauu" * 20_000
    cost, audit = parse(cells)
    turns = list(apply(audit, (({"s": "system", "u": "user", "a": "assistant"}[c], "t") for c in cells)))
    assert cost > 0 and len(audit.replace("I", "")) == len(cells)
    assert [t[0][0] for t in turns[:3]] == ["s", "u", "a"] and all(a[0] != b[0] for a, b in zip(turns, turns[1:], strict=False))


SCHEMA = "conv_id long, turn long, role string, text string, conv string, block int, turns string, live boolean"


def chats(spark, n, seed):
    r = random.Random(seed)
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(r.randrange(1, 30)):
            row = (conv, r.choice([turn, turn, None, turn + 1]), r.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]), r.choice(["yes.", "no", "", " \n", None, f"{turn}!", "à?"]))
            rows += [(*row, "k", 1, "x", r.random() < 0.9)] * r.choice([1, 1, 1, 2, 5])
    r.shuffle(rows)
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((r[1], r[2] if r[2] is not None else " ", r[3] if r[3] is not None else " ") for r in rows if r[0] == conv and r[7]), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, cells, n = set(), "", [0, 0, 0]
        for _, role, text in own:
            bare = text.strip(" \t\n\x0b\x0c\r")
            cell = role[:1] if role[:1] and role[:1] in "sua" else "x"
            if not bare:
                cell, n[0] = "d", n[0] + 1
            elif (role, text) in seen:
                cell, n[1] = "d", n[1] + 1
            elif bare[-1] not in ".!?":
                cell, n[2] = cell.upper(), n[2] + 1
            seen.add((role, text))
            cells += cell
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit = parse(cells)
        lines = "\n".join(f"{r}:{t}" for r, t in apply(audit, iter([x[1:] for x in own])))
        out["" if conv is None else f"={conv}"] = (gaps, *n, illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest())
    return out


@pytest.mark.parametrize("large", [20_000, 6])
def test_whole_and_in_blocks(spark, monkeypatch, large):
    monkeypatch.setattr(conversation_repair, "LARGE", large)
    rows, df = chats(spark, 12, 5)
    repaired = repair_conversations(df, live=F.col("live"))
    if large == 6:
        assert repaired.filter("blocks > 1").count() > 12
    got = {r["conv"]: tuple(r)[-8:] for r in with_digests(repaired).select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "digest").collect()}
    assert got == expected(rows)


def test_empty_and_dead(spark):
    _, df = chats(spark, 2, 1)
    assert with_digests(repair_conversations(df.limit(0))).count() == 0
    rows = with_digests(repair_conversations(df, live=F.lit(False))).collect()
    assert {r["conv"] for r in rows} == {"", "=0", "=1"}
    assert {(r["gaps"], r["cost"], r["audit"], r["digest"]) for r in rows} == {(0, 0, "", hashlib.sha256(b"").hexdigest())}
