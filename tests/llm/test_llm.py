"""The training-data operators: oracles, brute force, and odd tables.

Odd tables hold nulls in every column, empty and blank texts, a very long text, repeated rows and
extra columns whose names operators use themselves.
"""

import hashlib
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftwork.llm import (
    embedding_dedup,
    graph_search,
    html_extract,
    line_dedup,
    minhash_dedup,
    mixing,
    quality,
    sentencepiece_codec,
    substring_dedup,
    url_filter,
)
from siftwork.llm.components import components
from siftwork.llm.registry import ORACLES, QUERIES
from siftwork.llm.vectors import unit
from siftwork.llm.words import slices
from tests.compare import SMALL, oracle_rows, rows_of

LONG = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, n_lines long, ids string, kept boolean, verdict string, token long"


def odd_docs(spark):
    clash = (7, "k", 9, "z", False, "v", 1)
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "a b"), (5, LONG), (6, LONG), (6, LONG), (None, "a null id"), (7, "A B"),
        (8, "One line that is long enough to count\nmine"), (9, "ONE line that is long enough to count \nyours"), (10, "\tone line that is long enough to count"),
    ]
    return spark.createDataFrame([(i, t, None, None if i == 4 else "s", None, *clash) for i, t in rows], SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(spark, name):
    assert rows_of(QUERIES[name](spark, SMALL)) == oracle_rows(ORACLES[name])


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


# -- components


def test_components_on_random_graphs(spark):
    r = random.Random(1)
    for n, m in ((30, 20), (60, 80), (5, 0)):
        links = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(100, 130)] + [(3, 3)]
        root = {x: x for e in links for x in e}

        def top(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            a, b = top(a), top(b)
            root[max(a, b)] = min(a, b)
        got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
        assert got == {x: top(x) for x in root if any(a != b and x in (a, b) for a, b in links)}


# -- 1 MinHash


def test_minhash_odd(spark):
    got = minhash_dedup.near_duplicates(odd_docs(spark)).collect()
    assert len(got) == 12
    own = {r.doc_id: r for r in got}
    assert [own[i].n_shingles for i in (1, 2, 3, 4, 5)] == [0, 0, 0, 1, 29_996]
    assert (own[7].component_id, own[6].component_id, own[1].component_id, own[None].component_id) == (4, 5, 1, None)
    assert [own[i].kept for i in (1, 4, 5, 6, 7, None)] == [True, True, True, False, False, True]
    assert minhash_dedup.near_duplicates(empty_docs(spark)).count() == 0


def test_minhash_is_brute_force_around_the_threshold(spark):
    r = random.Random(3)
    texts = []
    for _ in range(6):  # families that drift away from a base, with J from 0.5 to 1
        text = [f"w{r.randrange(10**6)}" for _ in range(120)]
        for _ in range(14):
            text = list(text)
            for _ in range(r.choice((0, 1, 1, 2, 3))):
                text[r.randrange(len(text))] = f"w{r.randrange(10**6)}"
            texts.append(" ".join(text))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    comp = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) and comp[i] != comp[j]:
            a, b = sorted((comp[i], comp[j]))
            comp = [a if c == b else c for c in comp]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {x.doc_id: x.component_id for x in minhash_dedup.near_duplicates(docs).collect()}
    assert got == dict(enumerate(comp))
    assert len(set(comp)) < len(texts)


def test_parity_never_rejects_more_than_differs():
    r = np.random.default_rng(0)
    for n, d in ((100, 3), (5000, 400), (40, 40)):
        a = r.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate((a[d:], r.integers(0, 2**63, d).astype(np.uint64)))
        apart = int(np.bitwise_count((minhash_dedup.parity(a) ^ minhash_dedup.parity(b)).view(np.uint64)).sum())
        assert apart <= 2 * d


def test_minhash_rows_of_one_id(spark):
    """An id with several texts is one node, which links with whatever any of them links with."""
    r = random.Random(5)
    text = lambda: [f"w{r.randrange(10**6)}" for _ in range(100)]
    near = lambda t: " ".join([*t[:40], "new", *t[41:]])
    a, b, c, d = text(), text(), text(), text()
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (4, " ".join(c)), (5, " ".join(c)), (5, " ".join(d)), (6, " ".join(d)), (7, near(d)), (8, "alone")]
    got = minhash_dedup.near_duplicates(spark.createDataFrame([*rows, *rows[:3]], "doc_id long, text string").repartition(3)).collect()
    assert {(x.doc_id, x.component_id) for x in got} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 4), (7, 4), (8, 8)}
    assert len(got) == 13 and all(x.kept == (x.doc_id == x.component_id) for x in got)


def test_minhash_long_lists_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "LIST_BLOCK", 3)
    monkeypatch.setattr(minhash_dedup, "BROADCAST_PAIRS", 0)
    test_minhash_is_brute_force_around_the_threshold(spark)


# -- 2 SentencePiece

TEXTS = [
    "Hello  world\n\nfoo   bar ", "   ", "", "a", "日本語 テスト 😀 x", "tabs\tand\r\nnew", "aaaa aaaaa aaaaaa", "x" * 70, "a\xa0b ▁", "\x00a", "  " * 20 + "z", LONG[:40_000],
]


def test_sentencepiece_equals_the_library(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    r = random.Random(5)
    texts = TEXTS + ["".join(r.choices("abcdefghinorst  \n.,éß日ö▁", k=120)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.ids for x in sentencepiece_codec.encode_documents(docs).collect()}
    for i, t in enumerate(texts):
        assert got[i] == lib.encode(t), t[:50]
    decode = sentencepiece_codec.decode_udf(spark)
    back = sentencepiece_codec.encode_documents(docs).select("doc_id", decode(F.col("ids")).alias("t")).collect()
    assert {x.doc_id: x.t for x in back} == {i: t.replace("▁", " ") for i, t in enumerate(texts)}


def test_unigram_is_brute_force_viterbi():
    r = random.Random(2)
    pieces = ["<unk>", *"abc▁", "ab", "bc", "abc", "▁a", "ca", "cab", "bb"]
    scores = np.array([0.0] + [-r.uniform(1, 9) for _ in pieces[1:]])
    model = sentencepiece_codec.Pieces(pieces, scores, np.array([2] + [1] * (len(pieces) - 1)), bpe=False)
    words = ["▁" + "".join(r.choices("abc", k=r.randint(1, 9))) for _ in range(80)]
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(w) for w in words])
    at, ids = model.encode_parts(codes, np.concatenate(([0], ends[:-1])), ends)
    value = dict(zip(pieces[1:], scores[1:], strict=True))

    def best(w):
        return 0.0 if not w else max((value[w[:k]] + best(w[k:]) for k in range(1, len(w) + 1) if w[:k] in value), default=-np.inf)

    for k, w in enumerate(words):
        own = ids[at[k] : at[k + 1]]
        assert "".join(pieces[i] for i in own) == w
        assert scores[own].sum() == pytest.approx(best(w))


def test_unigram_walk_is_the_batched_lattice():
    r = random.Random(4)
    pieces = ["<unk>", *"abc▁", "ab", "bc", "abc", "▁a", "ca", "cab", "bb"]
    scores = np.array([0.0] + [-r.uniform(1, 9) for _ in pieces[1:]])
    model = sentencepiece_codec.Pieces(pieces, scores, np.array([2] + [1] * (len(pieces) - 1)), bpe=False)
    for n in (5, 40, 200):
        word = "▁" + "".join(r.choices("abc", k=n))
        codes = np.frombuffer(word.encode("utf-32-le"), np.uint32)
        assert scores[model.walk(word)].sum() == pytest.approx(scores[model.encode_parts(codes, np.array([0]), np.array([n + 1]))[1]].sum())


def test_sentencepiece_long_runs_and_words():
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    codec = sentencepiece_codec.Codec(sentencepiece_codec.read_model())
    r = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    texts = [" " * 100_000, "".join(r.choices(letters, k=1_000_000)), "a" * 30_000, "ab  " * 500_000, "é日" * 3000, *["".join(r.choices("ab ", k=n)) for n in range(240, 280)]]
    at, ids = codec.encode(texts)
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == lib.encode(text), text[:20]


def test_sentencepiece_words_of_one_hash(monkeypatch):
    """Remembered words are told apart by their characters, even where all hashes are alike."""
    codec = sentencepiece_codec.Codec(sentencepiece_codec.read_model())
    want = codec.encode(["one two three one", "two four"])
    monkeypatch.setattr(sentencepiece_codec, "ranges_hash", lambda v, start, end, base: np.zeros(len(start), np.uint64))
    other = sentencepiece_codec.Codec(codec.pieces)
    for _ in range(2):
        got = other.encode(["one two three one", "two four"])
        assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()


def test_sentencepiece_odd(spark):
    got = sentencepiece_codec.encode_documents(odd_docs(spark)).collect()
    assert len(got) == 12 and {r.doc_id: r.n_tokens for r in got}[1] == 0
    assert sentencepiece_codec.encode_documents(empty_docs(spark)).count() == 0
    decode = sentencepiece_codec.decode_udf(spark)
    assert [r[0] for r in spark.createDataFrame([([28705, 10**8, None],), (None,), ([],)], "ids array<int>").select(decode("ids")).collect()] == ["", None, ""]


# -- 3 substring dedup


def brute_substrings(docs, window=50):
    words = {i: (t or "").split() for i, t in docs}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, w in words.items():
        gone = {k + j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < i for j in range(window)}
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


def test_substring_is_brute_force(spark):
    r = random.Random(4)
    word = lambda: f"w{r.randrange(400)}"
    passages = [[word() for _ in range(r.randint(49, 140))] for _ in range(6)]
    docs = []
    for i in range(40):
        text = []
        for _ in range(r.randint(0, 4)):
            p = list(r.choice(passages))
            if r.random() < 0.4:
                p[r.randrange(len(p))] = word()
            text += [word() for _ in range(r.randint(0, 70))] + p[r.randint(0, 20) :]
        docs.append((i, " ".join(text)))
    docs += [(100, "same " * 300), (101, "same " * 120), (102, docs[3][1])]
    got = substring_dedup.substring_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    assert {x.doc_id: (x.n_words, x.n_removed, x.text) for x in got} == brute_substrings(docs)


def test_substring_odd(spark):
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(odd_docs(spark)).collect()}
    assert (got[5].n_removed, got[6].n_removed, got[6].text, got[1].text, got[None].text) == (0, 30_000, "", "", "a null id")
    assert substring_dedup.substring_dedup(empty_docs(spark)).count() == 0


def test_substring_rows_of_one_id(spark):
    """Texts of one id are one document: none is a reason to cut another, and each is cut on its own."""
    p = " ".join(f"p{i}" for i in range(70))
    q = " ".join(f"q{i}" for i in range(120))
    rows = [(1, p), (1, p + " more " + p), (1, p), (2, q), (2, "x " + q[:100]), (3, "a " + p + " b " + q), (3, q), (3, p)]
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, t int, spans string").repartition(3)
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(docs).collect())
    assert got == sorted([(1, 70, 0), (1, 141, 0), (1, 70, 0), (2, 120, 0), (2, len(q[:100].split()) + 1, 0), (3, 192, 190), (3, 120, 120), (3, 70, 70)])


def test_substring_compaction_steps(spark, monkeypatch):
    """A path ends where the documents that hold it change, and words are compared where hashes agree."""
    w = [f"w{i}" for i in range(400)]
    docs = [(1, " ".join(w)), (2, " ".join(w[:200])), (3, " ".join(w[100:300])), (4, " ".join(["y"] * 60 + w[250:] + ["z"]))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    plain = frame.select(F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("v"), "text")
    packed = plain.mapInArrow(substring_dedup._pack, "id long, v long, packed binary")
    paths = substring_dedup.compact_paths(substring_dedup.repeated_edges(plain, packed))
    assert sorted((r.id, r.low, r.n) for r in paths.collect()) == [(1, 0, 100), (1, 100, 51), (1, 151, 99), (1, 250, 1), (1, 251, 100)]
    got = {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(frame).collect()}
    assert got == {1: 0, 2: 200, 3: 200, 4: 150}
    monkeypatch.setattr(substring_dedup, "ranges_hash", lambda v, start, end, base: np.full(len(start), 5, np.uint64))  # all hashes alike
    frame = spark.createDataFrame([(1, " ".join(w[:50])), (2, " ".join(w[50:100])), (3, " ".join(w[:50]))], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(frame).collect()} == {1: 0, 2: 0, 3: 50}


# -- 4 quality


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    fit = labels.filter("doc_id % 2 = 0")
    got = quality.quality_sample(docs, fit)[0].join(labels.filter("doc_id % 2 = 1"), "doc_id").select("kept", "quality").collect()
    assert sum(r.kept == (r.quality == 1) for r in got) / len(got) > 0.97
    assert all(r.kept for r in got if r.quality == 1)


def test_quality_odd(spark):
    labels = spark.createDataFrame([(5, 1), (4, 0), (None, 1), (6, None)], "doc_id long, quality int")
    assert quality.quality_sample(odd_docs(spark), labels)[0].count() == 12
    assert quality.quality_filter(odd_docs(spark), labels.limit(0)).columns == odd_docs(spark).columns
    assert quality.quality_filter(odd_docs(spark), labels.limit(0)).count() == 12
    assert quality.quality_filter(empty_docs(spark), labels).count() == 0


def test_quality_is_brute_force(spark):
    """Weights, cut and sample of the query against counts by document in plain numpy."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None and r.doc_id in texts}
    grams = {}
    for i, t in texts.items():
        parts = list(slices(pa.array([t])))
        grams[i] = [np.concatenate([g[k] for p in parts if (g := quality.gram_buckets(p))] or [np.zeros(0, int)]) for k in range(6)]
    raw, target = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for i, kinds in grams.items():
        for k in kinds:
            np.add.at(raw, k, 1)
            if good.get(i):
                np.add.at(target, k, 1)
    model = np.log((target + quality.SMOOTH) / (raw / raw.sum() * target.sum() + quality.SMOOTH))
    weight = {i: sum(model[k].sum() for k in kinds) for i, kinds in grams.items()}
    got = {r.doc_id: r for r in QUERIES["op4_quality_classifier"](spark, "/root/testdata/sf0.001").collect()}
    assert got.keys() == texts.keys()
    for i, w in weight.items():
        assert got[i].log_weight == pytest.approx(w, rel=1e-9, abs=1e-6)
    own = sorted((weight[i], -g) for i, g in good.items())
    at = quality.best_cut(np.array([w for w, _ in own]), np.array([g < 0 for _, g in own]))
    k = sum(r.log_weight >= at for r in got.values())
    order = sorted((r.sort_key for r in got.values()), reverse=True)
    assert 0 < k < len(got) and all(r.kept == (r.sort_key >= order[k - 1]) for r in got.values())


def test_quality_weights_do_not_depend_on_batches(spark):
    texts = pa.array([r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()])
    model = np.random.default_rng(0).normal(size=quality.BUCKETS)
    whole = quality.log_weights(texts, model)
    assert (whole == np.concatenate([quality.log_weights(texts.slice(s, 7), model) for s in range(0, len(texts), 7)])).all()


def test_quality_clashing_names_and_ties(spark):
    rows = [(i, "good words of a text" if i % 2 else "x#x# 77 !!", 5, "s", True) for i in range(40)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, good int, sid string, kept boolean")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    kept = quality.quality_filter(docs, labels)
    assert kept.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in kept.groupBy("doc_id").count().collect()}
    assert counts and set(counts.values()) == {2}  # repeated rows are tied, and ties are kept together


def test_kth_largest(spark):
    r = random.Random(6)
    xs = [r.choice((r.gauss(0, 1), 2.0, -1e6, 1e300)) for _ in range(500)]
    rows = spark.createDataFrame([(x,) for x in xs], "x double")
    for k in (1, 2, 77, 250, 499):
        assert quality.kth_largest(rows, "x", k, bins=16) == sorted(xs, reverse=True)[k - 1]


# -- 5 embedding near-dedup


def odd_vectors(spark, dim=24, n=300, seed=0):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n, dim))
    near = base[:60] + r.normal(size=(60, dim)) * r.uniform(0.02, 0.12, size=(60, 1)) * np.linalg.norm(base[:60], axis=1)[:, None]
    rows = [x.tolist() for x in np.concatenate((base, near, near[:20], base[:10] * 3))]
    odd = [None, [], [0.0] * dim, [None] + [1.0] * (dim - 1), [float("nan")] + [1.0] * (dim - 1), [float("inf")] + [1.0] * (dim - 1), [1.0, 2.0]]
    rows = [(i, x) for i, x in enumerate(rows + odd)] + [(None, [1.0] * dim)]
    return rows, spark.createDataFrame([(i, x, 1, "k") for i, x in rows], "vec_id long, embedding array<double>, rep int, tile string")


def test_embeddings_are_brute_force(spark):
    rows, df = odd_vectors(spark)
    got = {r.vec_id: r for r in embedding_dedup.embedding_near_duplicates(df).collect()}
    good = [(i, x) for i, x in rows[: -8]]
    x = unit(np.array([v for _, v in good]))
    link = (x @ x.T) >= 0.95
    np.fill_diagonal(link, False)
    comp = list(range(len(x)))
    for i, j in zip(*np.nonzero(link), strict=True):
        a, b = sorted((comp[i], comp[j]))
        comp = [a if c == b else c for c in comp] if a != b else comp
    assert len(got) == len(rows)
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (link[i].sum(), comp[i], comp[i] == i)
    for i in range(len(x), len(rows) - 1):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[None].kept and got[None].n_links == 0
    assert embedding_dedup.embedding_near_duplicates(df.limit(0)).count() == 0


def test_embedding_links_of_low_rank_copies(spark):
    r = np.random.default_rng(4)
    flat = r.normal(size=(1500, 3)) @ np.linalg.qr(r.normal(size=(64, 3)))[0].T  # every step lies in three of 64 dimensions
    x = unit(flat)
    link = (x @ x.T) >= 0.95
    np.fill_diagonal(link, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {v.vec_id: v.n_links for v in embedding_dedup.embedding_near_duplicates(df).collect()}
    assert got == dict(enumerate(link.sum(1).tolist()))


def test_embedding_reach(spark):
    """A smaller reach probes fewer lists: links found are exact, and most are found."""
    r = np.random.default_rng(7)
    base = unit(r.normal(size=(1500, 64)))
    x = unit(np.concatenate((base, base + r.normal(size=base.shape) * 0.03)))
    link = (x @ x.T) >= 0.95
    np.fill_diagonal(link, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {v.vec_id: v.n_links for v in embedding_dedup.embedding_near_duplicates(df, reach=0.3).collect()}
    assert all(got[i] <= n for i, n in enumerate(link.sum(1))) and sum(got.values()) / link.sum() >= 0.9


def test_embedding_groups_longer_than_a_tile(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "LEAST_BLOCK", 64)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 64)
    r = np.random.default_rng(2)
    x = unit(np.concatenate((r.normal(size=(1, 16)) + r.normal(size=(400, 16)) * 0.1, r.normal(size=(200, 16)))))
    link = (x @ x.T) >= 0.95
    np.fill_diagonal(link, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {v.vec_id: (v.n_links, v.component_id) for v in embedding_dedup.embedding_near_duplicates(df).collect()}
    comp = np.arange(len(x))
    while (new := np.minimum(comp, np.where(link, comp[None, :], len(x)).min(1))).tolist() != comp.tolist():
        comp = new
    assert got == {i: (int(n), int(c)) for i, (n, c) in enumerate(zip(link.sum(1), comp, strict=True))}


def written_to_shuffles(spark):
    """Bytes by stage."""
    gate, sc = spark.sparkContext._gateway, spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    stages = sc.statusStore().stageList(None, False, False, gate.new_array(gate.jvm.double, 0), gate.jvm.java.util.ArrayList())
    return {s.stageId(): s.shuffleWriteBytes() for s in map(stages.apply, range(stages.size()))}


def test_embedding_shuffles_grow_with_the_rows(spark, monkeypatch):
    """Vectors that probe many tiles are not written once for each of them."""
    monkeypatch.setattr(embedding_dedup, "LEAST_BLOCK", 64)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 64)
    x = np.random.default_rng(3).normal(size=(1000, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    before = written_to_shuffles(spark)
    assert embedding_dedup.embedding_near_duplicates(df).agg(F.sum("n_links")).first()[0] == 0
    assert sum(n for k, n in written_to_shuffles(spark).items() if k not in before) < 4 * x.nbytes


# -- 6 HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:">"}</style><script>var a="<p>no</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu one</a><li><a href="/b">Menu two</a></ul></nav><div class="ad">Buy now, cheap.</div>
<article><h1>A  title &amp;\n more</h1><p>First <b>bold</b>text, with a comma.<br>Then &eacute;&#8364; more.<p>Second paragraph of it.
<div class="comments"><h3>Replies</h3><p>I like it.</p></div></article><footer>&copy; me</footer></body></html>"""


def test_html_page():
    chain = html_extract.default_chain()
    assert html_extract.main_text(PAGE, chain) == "A title & more First boldtext, with a comma. Then é€ more. Second paragraph of it."


def test_html_is_the_article(spark):
    """On the test pages the main text is that of the article element, read by a parser of another kind, less its comments, adverts and the like."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.skip, self.out, self.now = 0, 0, [], []

        def flush(self):
            if text := " ".join("".join(self.now).split()):
                self.out.append(text)
            self.now = []

        def handle_starttag(self, tag, attrs):
            if tag not in html_extract.INLINE:
                self.flush()
            self.inside += tag == "article"
            self.skip += tag in ("script", "style")

        def handle_endtag(self, tag):
            if tag not in html_extract.INLINE:
                self.flush()
            self.inside -= tag == "article"
            self.skip -= tag in ("script", "style")

        def handle_data(self, data):
            if self.inside and not self.skip:
                self.now.append(data)

    rows = QUERIES["op6_html_extraction"](spark, SMALL).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    seen = 0
    for r in rows:
        if "<article" in (pages[r.page_id] or ""):
            reader = Reader()
            reader.feed(pages[r.page_id])
            reader.close()
            reader.flush()
            seen += 1
            assert r.text == " ".join(reader.out) and r.n_chars == len(r.text)
    assert seen > 0.9 * len(rows) > 0


def test_html_deep_nesting_is_linear():
    chain = html_extract.default_chain()
    for page in ("<div>a" * 30_000, "<p><table>" + "<div class=x>a" * 30_000 + "</b>" * 30_000, "<a>" * 30_000 + "b" + "</a>" * 30_000):
        html_extract.main_text(page, chain)


def test_html_held_out():
    chain = html_extract.default_chain()
    good = total = 0
    for page in html_extract.labelled_pages(150, 77):
        blocks = html_extract.leaf_blocks(page)
        good += sum(y == (b.label or 0) for y, b in zip(chain.decode(blocks), blocks, strict=True))
        total += len(blocks)
    assert good / total > 0.97


def test_html_viterbi_is_brute_force():
    chain = html_extract.default_chain()
    for page in html_extract.labelled_pages(20, 5):
        blocks = html_extract.leaf_blocks(page)[:9]
        e, s = chain.score(blocks), chain.steps
        value = lambda y, e=e, s=s: sum(a * b for a, b in zip(e, y, strict=True)) + sum(s[a, b] for a, b in itertools.pairwise(y))
        assert value(chain.decode(blocks)) == pytest.approx(max(value(y) for y in itertools.product((0, 1), repeat=len(blocks))))


def test_html_odd(spark):
    pages = ["", None, "plain", "<", "<p", "a<b>c", "<article><p>" + "word, " * 50_000 + "</p></article>", "<div " * 2000, "<!-- open", "<script>never", "<article><p>x</p></article>" * 2]
    rows = spark.createDataFrame([(i, None, p, "old", 5) for i, p in enumerate(pages)], "page_id long, url string, html string, text string, n_chars int")
    got = {r.page_id: r for r in html_extract.extract_text(rows).collect()}
    assert (got[0].text, got[1].text, got[0].n_chars) == ("", "", 0) and got[6].n_chars == 6 * 50_000 - 1
    assert got[10].text == "x x"
    assert html_extract.extract_text(rows.limit(0)).count() == 0


def test_html_foreign_data_label(spark):
    page = '<article><h1>Prices</h1><table><tr><td data-label="Price">Ten, or so.</td><td data-label="">Two.</td><td data-label=0>One.</td></tr></table></article>'
    rows = spark.createDataFrame([(1, page), (2, page.replace("data-label", "data-x"))], "page_id long, html string")
    got = {r.page_id: r.text for r in html_extract.extract_text(rows).collect()}
    assert got[1] == got[2] == "Prices Ten, or so. Two. One."


def test_html_elements_that_hide_nothing():
    chain = html_extract.default_chain()
    text = lambda inner: html_extract.main_text(f"<body><article><h1>Title of it</h1><p>First one, as it is.</p>{inner}<p>Last one, as it is.</p></article></body>", chain)
    whole = "Title of it First one, as it is.{} Last one, as it is."
    for tag in ("svg", "math", "object", "canvas", "noscript", "template", "iframe", "select"):
        assert text(f"<{tag} width=1>") == whole.format("")
    assert text("<svg><svg></svg>") == whole.format("")
    assert text("<svg><text>no</text><svg></svg><text>no</text></svg><svg/>") == whole.format("")
    assert text("<p>Here <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds, too.</p>") == whole.format(" Here x=1 holds, too.")
    for tag in ("object", "canvas", "noscript"):
        assert text(f"<{tag}><p>Fallback, as it is.</p></{tag}>") == whole.format(" Fallback, as it is.")
    assert html_extract.leaf_blocks("<svg>" * 50_000 + "x")[0].text == "x"


# -- 7 mixing


def test_mixing_is_brute_force(spark):
    r = random.Random(8)
    docs = [(i, "big" if i % 3 else f"s{i % 4}", " ".join("w" for _ in range(r.randint(1, 30)))) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    tokens = {}
    for _, s, t in docs:
        tokens[s] = tokens.get(s, 0) + len(t.split())
    total = sum(tokens.values())
    counted, plan = mixing.mixing_plan(df, gain=0.5, max_repeats=4.0)
    got = {r.skey[1:]: r for r in plan.collect()}
    share = np.array([v / total for v in tokens.values()])
    entropy = lambda x: -sum(q * np.log(q) for q in share**x / (share**x).sum())
    goal = entropy(1.0) + 0.5 * (np.log(len(share)) - entropy(1.0))
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if entropy(mid) >= goal else (low, mid)
    weights = share**low / (share**low).sum()
    for s, w in zip(tokens, weights, strict=True):
        assert got[s].weight == pytest.approx(w, rel=1e-6)
    used = mixing.mix(df).groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("t")).collect()
    for r_ in used:  # the document that fills a budget may exceed it
        assert 0 <= r_.t - got[r_.source].budget < 30
    epochs = mixing.mix(df).groupBy("source", "doc_id").count().groupBy("source").agg(F.min("count").alias("a"), F.max("count").alias("b")).collect()
    assert all(e.b - e.a <= 1 for e in epochs)


def test_mixing_uses_are_brute_force(spark, monkeypatch):
    """Epoch, block and place of every use, with the plan broadcast and with it joined."""
    r = random.Random(3)
    docs = [(i, "big" if i % 4 else f"s{i % 12}", " ".join("w" for _ in range(r.randint(0, 20)))) for i in range(500)] + [(900, None, "a b"), (901, "void", "")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    plan = {r_.skey: r_ for r_ in mixing.mixing_plan(df)[1].collect()}
    tokens: dict = {}
    for i, s, t in docs:
        tokens.setdefault("-" if s is None else "+" + s, []).append((i, len(t.split())))
    most = max(p.epochs for p in plan.values()) + 1
    places = {(x.id, x.e): x.p for x in spark.range(1000).crossJoin(spark.range(most).withColumnRenamed("id", "e")).select("id", "e", mixing._place(F.col("id"), F.col("e"), 29).alias("p")).collect()}
    want = set()
    for key, own in tokens.items():
        total, budget = sum(n for _, n in own), plan[key].budget
        epochs = budget // total if total else 1
        want |= {(i, e, places[i, e]) for i, _ in own for e in range(epochs)}
        left = budget - epochs * total if total else 0
        for p, i, n in sorted((places[i, epochs], i, n) for i, n in own):
            if left <= 0:
                break
            want.add((i, epochs, p))
            left -= n
    for size in (mixing.PLAN_BYTES, -1):
        monkeypatch.setattr(mixing, "PLAN_BYTES", size)
        with monkeypatch.context() as m:
            m.setattr(mixing, "table", lambda spark_, sf_dir, name: df)
            got = mixing.op7_source_mixing(spark, "").collect()
        assert len(got) == len(want) and {(x.doc_id, x.epoch, x.place) for x in got} == want
        assert all(x.block == x.place >> 50 for x in got)
        assert sorted(x.doc_id for x in mixing.mix(df).collect()) == sorted(i for i, *_ in want)


def test_mixing_repetition_limit(spark):
    docs = spark.createDataFrame([(i, "a" if i else "b", "w " * 10) for i in range(1000)], "doc_id long, source string, text string")
    most = mixing.mix(docs, gain=1.0, max_repeats=3.0).filter("source = 'b'").count()
    assert most == 3


def test_mixing_odd(spark):
    got = mixing.mix(odd_docs(spark))
    assert got.columns == odd_docs(spark).columns and got.filter("source is null").count() > 0
    assert mixing.mix(empty_docs(spark)).count() == 0
    assert mixing.mix(odd_docs(spark).filter("text = ''")).count() == 1


# -- 8 URLs


def test_url_cases(spark):
    urls = [None, "", "no scheme", "://", "HTTP://WWW.Example.COM/en/7?x", "http://a.com/en/1", "http://net/de/", "http://x.example.net/de/8#a", "https://free-bets.example.net/x",
            "http://freebets.example.net/", "http://casino.fr", "http://a.org/es/x://y", "http://notnet/de/", "http://casino.fr:80?casino", "http://a.fr/?q=porn", "casino.fr/x", "http://a.fr/#free-offer", "http://a.fr/?essex"]
    df = spark.createDataFrame([(u, "h", "v") for u in urls], "url string, host string, verdict string")
    got = url_filter.url_filter(df).collect()
    assert [r.host for r in got[:5]] == ["", "", "", "", "www.example.com"]
    assert [r.rule for r in got] == [None, None, None, None, "example.com/en/7", "com/en/", "net/de/", "example.net/de/8", None, None, None, "org/es/", *[None] * 6]
    assert [r.verdict for r in got] == ["allow"] * 5 + ["block", "allow", "block", "block", "allow", "block", "block", "allow", "block", "block", "block", "block", "allow"]
    assert url_filter.url_filter(df.limit(0)).count() == 0


# -- 9 lines


def test_lines_odd(spark):
    got = {r.doc_id: r for r in line_dedup.line_dedup(odd_docs(spark)).collect()}
    assert (got[1].text, got[1].n_lines, got[2].text, got[3].text) == (None, 1, "", " \n\t ")
    assert (got[8].text, got[9].text, got[10].text) == ("mine", "yours", "\tone line that is long enough to count")
    assert [got[i].n_dropped for i in (8, 9, 10)] == [1, 1, 0]
    assert line_dedup.line_dedup(empty_docs(spark)).count() == 0


def test_lines_count_documents_not_rows(spark):
    line = "a line of at least twenty characters"
    docs = spark.createDataFrame([(1, line), (1, line), (2, f"{line}\n{line}")], "doc_id long, text string")
    assert line_dedup.line_dedup(docs).agg(F.sum("n_dropped")).first()[0] == 0


def test_lines_of_one_id_and_many_lines(spark):
    line = lambda i: f"a line that is long enough {i}"
    many = "\n".join(line(i) for i in range(60_000))
    rows = [(1, many), (2, many), (3, many + "\nlast"), (4, f"x\n{line(5)}"), (4, f"{line(5)}\ny\n{line(5)}"), (None, line(5))]
    docs = spark.createDataFrame([(i, t, 1, 2, "k") for i, t in rows], "doc_id long, text string, pos int, t int, h1 string").repartition(3)
    got = {(r.doc_id, r.n_lines, r.n_dropped, r.text if r.doc_id != 3 else r.text[-40:]) for r in line_dedup.line_dedup(docs).collect()}
    assert got == {
        (1, 60_000, 60_000, ""), (2, 60_000, 60_000, ""), (3, 60_001, 1, many[-35:] + "\nlast"),
        (4, 2, 0, f"x\n{line(5)}"), (4, 3, 0, f"{line(5)}\ny\n{line(5)}"), (None, 1, 0, line(5)),
    }


def test_hot_keys_are_dealt(spark, monkeypatch):
    from siftwork.llm import skew

    monkeypatch.setattr(skew, "HOT_ROWS", 20)
    rows = spark.range(1000).select(F.when(F.col("id") < 700, 0).otherwise(F.col("id") % 7).alias("k"), "id")
    facts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("m")).filter("k <> 3")
    got = skew.dealt_join(rows, facts, ["k"], "n").select("k", "id", "n", "m")
    assert rows_of(got) == rows_of(rows.join(facts, "k").select("k", "id", "n", "m"))
    test_equals_oracle(spark, "op9_line_dedup")
    test_equals_oracle(spark, "op3_substring_dedup")


# -- 10 graph search


def test_graph_recall():
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 48))
    q = x[::60]
    found, far = graph_search.Shard(x, 11).search(q)
    exact = np.argsort(((q[:, None] - x[None]) ** 2).sum(2), axis=1)[:, :11]
    assert np.mean([len(set(a[:11]) & set(b)) / 11 for a, b in zip(found, exact, strict=True)]) >= 0.97
    assert far[0, 0] == 0


def test_search_odd(spark):
    rows, df = odd_vectors(spark, n=150, seed=3)
    got = graph_search.nearest(df, df.filter("vec_id % 50 = 0"), shard=64).collect()
    good = [(i, np.array(x)) for i, x in rows[:-8]]
    for q in {r.query_id for r in got}:
        own = sorted((float(np.sqrt(((x - good[q][1]) ** 2).sum())), i) for i, x in good if i != q)[:10]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [(k, i) for k, i, _ in mine] == [(k + 1, i) for k, (_, i) in enumerate(own)]
        assert [s for *_, s in mine] == pytest.approx([s for s, _ in own])
    few = df.filter("vec_id < 4")
    assert graph_search.nearest(few, few.filter("vec_id = 0")).count() == 3
    assert graph_search.nearest(df.limit(0), df).count() == 0 and graph_search.nearest(df, df.limit(0)).count() == 0


def test_search_over_shards_has_recall(spark):
    r = np.random.default_rng(9)
    x = r.normal(size=(2500, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(6)
    got = graph_search.nearest(df, df.filter("vec_id % 50 = 0"), shard=600).collect()
    exact = {q: set(np.argsort(((x[q] - x) ** 2).sum(1))[1:11].tolist()) for q in range(0, 2500, 50)}
    assert len(got) == 500 and sum(v.vec_id in exact[v.query_id] for v in got) / 500 >= 0.97


def test_search_repeated_rows(spark):
    r = np.random.default_rng(6)
    same, other = r.normal(size=8), r.normal(size=(40, 8))
    vecs = [*[same] * 14, *other]
    rows = [(i, v.tolist()) for i, v in enumerate(vecs)] * 2 + [(3, same.tolist())] * 30
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = graph_search.nearest(df, df.filter("vec_id IN (0, 5, 20)")).collect()
    for q in (0, 5, 20):
        own = sorted((float(np.sqrt(((v - vecs[q]) ** 2).sum())), i) for i, v in enumerate(vecs) if i != q)[:10]
        assert sorted((x["rank"], x.vec_id) for x in got if x.query_id == q) == [(k + 1, i) for k, (_, i) in enumerate(own)]


# -- pipeline


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, SMALL)
        assert out.columns == docs.columns
        kept = out.cache()
    last = corpus_pipeline.STAGES[-1][1](spark, kept, SMALL)
    whole = corpus_pipeline.run(spark, SMALL)
    assert rows_of(whole) == rows_of(last)
    good = quality.quality_filter(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    lines = line_dedup.line_dedup(good).select("doc_id", "text")
    near = minhash_dedup.near_duplicates(lines).filter("kept").select("doc_id")
    assert {r.doc_id for r in whole.select("doc_id").collect()} <= {r.doc_id for r in near.collect()}
    text = {r.doc_id: r.text for r in lines.collect()}
    decode = sentencepiece_codec.decode_udf(spark)
    assert all(text[r.doc_id] == r.t for r in whole.select("doc_id", decode("ids").alias("t")).collect())


def test_pipeline_near_dedup_is_brute_force_at_80(spark):
    import corpus_pipeline

    r = random.Random(8)
    texts = []
    for changed in (1, 2, 2, 2, 2, 3, 3):  # words; similarities 0.91, 0.82 and 0.74
        text = [f"w{r.randrange(10**6)}" for _ in range(105)]
        copy = [f"x{r.randrange(10**6)}" if i in range(20, 20 + 20 * changed, 20) else w for i, w in enumerate(text)]
        texts += [" ".join(text), " ".join(copy)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    gone = {j for i, j in itertools.combinations(range(len(texts)), 2) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, SMALL).collect()} == set(range(len(texts))) - gone
    assert len(gone) == 5


def test_pipeline_stages_on_odd_tables(spark, monkeypatch):
    import corpus_pipeline

    docs = odd_docs(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for table_ in (docs, docs.limit(0)):
        kept = table_
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, SMALL)
            assert kept.columns == docs.columns
        out = corpus_pipeline.STAGES[-1][1](spark, kept, SMALL)
        assert out.count() == kept.count() <= 2 * table_.count()


def test_digest_of_nothing():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
