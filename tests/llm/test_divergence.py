"""Source divergence against its definition, and the radix selection against sorting."""

import random
import re
from collections import Counter, defaultdict

from siftwork.llm.divergence import first_ranked, source_divergence
from tests.llm.test_llm import empty_docs, odd_docs

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def expected(docs, min_docs, top):
    """docs: (lang, source, text)."""
    count, held, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in docs:
        lang, source, terms = lang or "", source or "", [t.translate(UPPER) for t in TERM.findall(text or "")]
        groups.add((lang, source))
        count[lang, source].update(terms)
        held[lang].update(set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in held[lang].items() if n >= min_docs]
        whole = sum((count[g] for g in groups if g[0] == lang), Counter())

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p, q = {g[1]: shares(count[g]) for g in groups if g[0] == lang}, shares(whole)
        for a in p:
            pairs = [(b, sum(abs(p[a][t] - p[b][t]) for t in kept)) for b in p if b != a]
            terms = [(t, p[a][t] - q[t]) for t in kept if count[lang, a][t] and p[a][t] > q[t]]
            for part, rows, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (item, value) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0].encode()))[:most], 1):
                    out.add((lang, a, part, item, value, rank))
    return out


def rows_of(df):
    return [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]


def test_equals_definition(spark):
    r = random.Random(2)
    words = ["the", "The", "été", "ÉTÉ", "a", "b", "日本", "x1y", "don't", *(f"w{c}" for c in "abcdefghij")]
    docs = []
    for i in range(300):
        source = r.choice(["hot", "hot", "s1", "s2", None, "S1", "z", "é"])
        docs.append((r.choice(["en", "fr", None]), source, r.choice([None, "", " 1 2 ", *([" ".join(r.choices(words[: r.randrange(1, len(words))], k=r.randrange(40)))] * 9)])))
    docs += [("xx", "only", "alone"), ("yy", "a", None), ("yy", "b", "")] + docs[:5]
    df = spark.createDataFrame([(*d, 1, "k", 2, 3) for d in docs], "lang string, source string, text string, z long, term string, held long, p long").repartition(5)
    for min_docs, top in ((5, 50), (1, 4)):
        got = rows_of(source_divergence(df, min_docs=min_docs, top=top))
        assert len(got) == len(set(got)) and set(got) == expected(docs, min_docs, top)


def test_odd_tables(spark):
    df = odd_docs(spark)
    assert set(rows_of(source_divergence(df, min_docs=2))) == expected([(r["lang"], r["source"], r["text"]) for r in df.collect()], 2, 50)
    assert source_divergence(empty_docs(spark)).count() == 0


def test_first_ranked(spark):
    r = random.Random(4)
    rows = [("hot", r.choice([7, 7, 7, 2**40 + 1, 2**40, 3]), f"té{i % 50:03d}{i}") for i in range(3000)] + [("few", 1, "b"), ("few", 1, "a"), ("one", 0, "")]
    rows += [("same", 5, "x" * i) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, value long, item string").repartition(4)
    for k in (1, 10, 700):
        want = set()
        for g in {x[0] for x in rows}:
            own = sorted((x for x in rows if x[0] == g), key=lambda x: (-x[1], x[2].encode()))[:k]
            want |= {(*x, i) for i, x in enumerate(own, 1)}
        assert {tuple(x) for x in first_ranked(df, ["g"], k).collect()} == want


def test_codes_are_never_shared(spark, monkeypatch):
    """Two names of one code make another seed."""
    from pyspark.sql import functions as F

    from siftwork.llm import divergence

    names = spark.createDataFrame([("en", "a"), ("fr", "a"), ("en", "b")], "lang_name string, source_name string")
    assert {r["seed"] for r in divergence.group_codes(names).collect()} == {0}
    real = divergence._code
    monkeypatch.setattr(divergence, "_code", lambda name, seed: real(name, seed) if seed > 1 else F.length(name).cast("long"))
    got = divergence.group_codes(names).collect()
    assert {r["seed"] for r in got} == {2} and len({r["lang"] for r in got}) == 2 and len({r["source"] for r in got}) == 2
