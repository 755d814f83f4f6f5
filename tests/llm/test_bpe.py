"""BPE by a trie of words, against the library and an exact round trip."""

import hashlib
import random

import pytest
from tokenizers import Tokenizer

from siftwork.llm import bpe_codec
from siftwork.llm.bpe_codec import MODEL, Codec, Trie, encode_documents, encode_udf, decode_udf, read_vocabulary
from siftwork.llm.registry import QUERIES
from tests.compare import SMALL
from tests.llm.test_llm import LONG, empty_docs, odd_docs

END = "<|endoftext|>"
TEXTS = [
    "", END, f"a{END} b", f"{END}{END}x", "  a   b\n\n  c \t ", "aaaaaaaaaaaaaaa", "x" * 3000, " " * 500, "-" * 3000, "é" * 99, "\0\1", END[:-1],
    "it's 123abc 4x'reply", "don't 'd 's", "''s \"'s\n's", "　　x  y", "日本語 テキスト", LONG,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(MODEL)


def check(library, codec, texts):
    at, ids = codec.encode(texts)
    for i, text in enumerate(texts):
        own = ids[at[i] : at[i + 1]].tolist()
        assert own == library.encode(text or "", add_special_tokens=False).ids
        assert codec.decode(own) == library.decode(own, skip_special_tokens=False) == (text or "")


def test_equals_the_library(library, monkeypatch):
    r = random.Random(1)
    texts = TEXTS + ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(256), r.randrange(0x3000), r.randrange(0x10000, 0x11000)])) for _ in range(r.randrange(200))) for _ in range(200)]
    texts += ["".join(r.choice("aab  01'\n-—srt") for _ in range(200)) for _ in range(200)]
    check(library, Codec(read_vocabulary(MODEL)), [None, *texts])
    for slice_chars, cache in ((40, 400_000), (1000, 50)):  # texts cut between words, words forgotten
        monkeypatch.setattr(bpe_codec, "SLICE_CHARS", slice_chars)
        monkeypatch.setattr(bpe_codec, "CACHE_WORDS", cache)
        check(library, Codec(read_vocabulary(MODEL)), texts[:-1])


def test_words_of_every_character(library):
    vocab = read_vocabulary(MODEL)
    for low in range(0, 0x110000, 64):
        chars = [chr(c) for c in range(low, low + 64) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{c}1{c}!{c} {c}\n{c}'{c}" for c in chars)
        assert [w for ws in vocab.words(text) for w in ws] == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]


def test_every_token_is_its_own_encoding_and_prefixes_are_shared():
    vocab = read_vocabulary(MODEL)
    words = [b" transport", b" transports", b" transporting", b" transit"]
    trie = Trie(vocab, words)
    assert len(trie.token) == 1 + len({w[:n] for w in words for n in range(1, len(w) + 1)})
    assert all(b"".join(vocab.bytes[i] for i in trie.ids(w)) == w for w in words)
    assert all(vocab.follows(-1, i) for i in vocab.ids.values())


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        read_vocabulary(MODEL.replace("byte_bpe_50k", "word_bpe_49k"))


def test_documents(spark, library):
    rows = encode_documents(odd_docs(spark)).collect()
    assert len(rows) == 12 and {"id", "key", "kept", "token"} <= set(rows[0].asDict())
    for r in rows:
        assert r["ids"] == library.encode(r["text"] or "", add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])
    assert encode_documents(empty_docs(spark)).count() == 0
    odd = spark.createDataFrame([([50256, 99999, None, -1, 15496],), (None,), ([],)], "ids array<int>")
    assert [x[0] for x in odd.select(decode_udf(spark)("ids")).collect()] == ["<|endoftext|>Hello", None, ""]
    back = odd_docs(spark).select("text", decode_udf(spark)(encode_udf(spark)("text")).alias("back")).collect()
    assert all(x["back"] == (x["text"] or "") for x in back)


def test_query(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = QUERIES["op12_bpe"](spark, SMALL).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
