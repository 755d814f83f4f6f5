"""Byte-level BPE encoding and decoding by a trie of words.

The distinct words of a stretch of text are inserted into a trie of bytes. A depth-first walk gives each
node the last token of the encoding of its prefix and the node where that token starts: of the
tokens that end there, exactly one may follow the last token of what is before it. So the encoding of
a shared prefix is computed once, and a word's ids are read off along the links from its end.

That rests on two facts of merging by rank, leftmost first among equals: a prefix of an encoding that ends
between tokens is itself an encoding, and tokens are an encoding if each two neighbours are one. Whether two
tokens are is found by merging the bytes of both, and remembered.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.session import SMALL_BATCHES, own_session, table

#: Vocabulary of the queries; every function takes another path.
MODEL = public_tokenizers.path("byte_bpe_50k.json")
#: Characters of text cut into words at once, words remembered, and pairs of tokens remembered. More only takes longer.
SLICE_CHARS, CACHE_WORDS, CACHE_PAIRS = 1_000_000, 400_000, 2_000_000
#: Letters and numbers that Unicode has had only since version 16, which the format's word pattern takes for marks.
NEW = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE "
    "11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA "
    "18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE "
    "1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
#: The endings that the format keeps as words of their own.
ENDINGS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
MARK, SPACE, LETTER, NUMBER = range(4)


def kinds() -> np.ndarray:
    """The kind of each character: letter, number, white space, or a mark, which is all else."""
    every = "".join(map(chr, range(0xD800))) + " " * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    for span in NEW.split():
        low, _, high = span.partition("-")
        out[int(low, 16) : int(high or low, 16) + 1] = MARK
    return out


def byte_of_char() -> dict[str, int]:
    """The format's rule: printable bytes stand for themselves, the others, in order, for characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens and merges of a file. Files with settings that the queries' file lacks are refused."""

    def __init__(self, raw: bytes):
        file = json.loads(raw)
        model, pre = file["model"], file["pre_tokenizer"] or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and file["normalizer"] is None
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or not plain or odd or (file["decoder"] or {}).get("type") != "ByteLevel":
            raise ValueError("not a plain byte-level BPE file")
        byte = byte_of_char()
        self.ids = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items()}
        self.added = {}
        for t in file["added_tokens"]:
            if t["single_word"] or t["lstrip"] or t["rstrip"]:
                raise ValueError("added tokens that take in what is around them")
            self.added[t["content"]] = t["id"]
        self.bytes = dict(zip(self.ids.values(), self.ids, strict=True)) | {i: t.encode() for t, i in self.added.items()}
        self.base = [self.ids[bytes([b])] for b in range(256)]
        self.kind = kinds()
        self.endings = {x[1:].encode("utf-32-le"): len(x) - 1 for x in ENDINGS}
        #: Rank of the merge of two tokens; and of each token the merge that makes it: (rank, left, right).
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (bytes(byte[c] for c in x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            left, right, whole = self.ids[a], self.ids[b], self.ids[a + b]
            if whole in self.made or any(len(x) > 1 and self.made.get(t, (rank,))[0] >= rank for x, t in ((a, left), (b, right))):
                raise ValueError("merges out of order, or two merges of one token")
            self.rank[left, right], self.made[whole] = rank, (rank, left, right)
        self.clear()

    def clear(self) -> None:
        """Forget what was found while encoding: tokens that follow each other, and states of the suffix automaton."""
        self.pairs: dict[int, bool] = {}
        self.next: dict[int, int] = {}
        self.states: list[bytes] = [b""]
        self.state: dict[bytes, int] = {b"": 0}
        self.ending: list[list[tuple[int, int]]] = [[]]

    @cached_property
    def prefixes(self) -> set[bytes]:
        return {t[:n] for t in self.ids for n in range(1, len(t) + 1)}

    @cached_property
    def splitter(self) -> regex.Pattern | None:
        names = sorted(self.added, key=len, reverse=True)
        return regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    def words(self, text: str) -> Iterator[list[str]]:
        """Words of a text by the format's rules, in lists of bounded length (a longer word makes a list of its own).

        A word is a run of one kind. The last white space before another kind is cut off from its run, and, if it is
        a space, begins the next word. An apostrophe alone that no space precedes forms a word with an ending.
        """
        at = 0
        while at < len(text):
            size = SLICE_CHARS
            while True:
                codes = np.frombuffer(text[at : at + size].encode("utf-32-le"), np.uint32)
                starts = self._starts(codes)
                if at + size >= len(text):
                    break
                sure = starts[starts < len(codes) - 4]  # what follows may change the last few; a run of white space goes on
                sure = sure[self.kind[codes[np.maximum(sure - 1, 0)]] != SPACE]
                if len(sure) and sure[-1]:
                    starts = starts[starts <= sure[-1]]
                    break
                size *= 2
            ends = np.append(starts[1:], len(codes)) if at + size >= len(text) else starts[1:]
            yield [text[a:b] for a, b in zip((starts[: len(ends)] + at).tolist(), (ends + at).tolist(), strict=True)]
            at += int(ends[-1])

    def _starts(self, codes: np.ndarray) -> np.ndarray:
        kind = self.kind[codes]
        new = np.ones(len(codes) + 1, bool)
        new[1:-1] = kind[1:] != kind[:-1]
        space = kind == SPACE
        cut = np.flatnonzero(space[:-1] & ~space[1:])
        new[cut] = True
        new[cut[codes[cut] == 32] + 1] = False
        for i in np.flatnonzero(codes == 39).tolist():
            if (i and (kind[i - 1] == MARK or codes[i - 1] == 32)) or (i + 1 < len(codes) and kind[i + 1] == MARK):
                continue
            size = self.endings.get(codes[i + 1 : i + 2].tobytes(), 0) or self.endings.get(codes[i + 1 : i + 3].tobytes(), 0)
            if size:
                new[i + 1], new[i + 1 + size] = False, True
        return np.flatnonzero(new[:-1])

    def step(self, state: int, byte: int) -> int:
        """The state after one more byte: the longest end of the bytes so far that begins a token."""
        found = self.next.get(state << 8 | byte)
        if found is None:
            own = self.states[state] + bytes([byte])
            while own not in self.prefixes:
                own = own[1:]
            found = self.state.get(own)
            if found is None:
                found = self.state[own] = len(self.states)
                self.states.append(own)
                ends = [own[i:] for i in range(len(own))]
                self.ending.append([(self.ids[x], len(x)) for x in ends if x in self.ids])
            self.next[state << 8 | byte] = found
        return found

    def follows(self, before: int, token: int) -> bool:
        """Whether token may stand after the token before (-1: at the start): whether merging the bytes of both gives both.

        Parts of a token appear in the order of their ranks. The two aren't kept apart if a part at the end of one
        and a part at the start of the other merge before either is taken up by its own token; of two equal merges
        the left one comes first.
        """
        key = (before + 1) << 32 | token
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._whole(token) and (before < 0 or not self._meet(before, token, len(self.rank)))
        return known

    def _meet(self, left: int, right: int, until: int) -> bool:
        """Whether a merge across the border of two tokens of a rank below until comes before both are made."""
        x, x_until = left, until
        while True:
            y, y_until = right, until
            while True:
                rank = self.rank.get((x, y), until)
                if rank < x_until and (rank < y_until or rank == y_until < until):
                    return True
                if y not in self.made:
                    break
                y_until, y, _ = self.made[y]
            if x not in self.made:
                return False
            x_until, _, x = self.made[x]

    def _whole(self, token: int) -> bool:
        """Whether a token's own bytes are encoded as that token."""
        if token not in self.made:
            return len(self.bytes[token]) == 1
        rank, left, right = self.made[token]
        return self.follows(-1, left) and self.follows(-1, right) and not self._meet(left, right, rank)


class Trie:
    """Words as paths from node 0. Nodes are numbered depth first, so parents come before children."""

    def __init__(self, vocab: Vocabulary, words: Iterable[bytes]):
        self.token, self.start = [-1], [0]
        self.end: dict[bytes, int] = {}
        path, last, states, before = [0], [-1], [0], b""  # node, last token and state of the suffix automaton, by depth
        for word in sorted(words):
            shared = 0
            for x, y in zip(word, before, strict=False):
                if x != y:
                    break
                shared += 1
            del path[shared + 1 :], last[shared + 1 :], states[shared + 1 :]
            state = states[-1]
            for end in range(shared + 1, len(word) + 1):
                key = state << 8 | word[end - 1]
                state = vocab.next[key] if key in vocab.next else vocab.step(state, word[end - 1])
                for token, size in vocab.ending[state]:
                    key = (last[end - size] + 1) << 32 | token
                    if vocab.pairs[key] if key in vocab.pairs else vocab.follows(last[end - size], token):
                        break
                else:
                    raise AssertionError("every prefix has an encoding")
                path.append(len(self.token))
                last.append(token)
                states.append(state)
                self.token.append(token)
                self.start.append(path[end - size])
            self.end[word], before = path[-1], word

    def ids(self, word: bytes) -> list[int]:
        """Tokens along the links from the word's end, first one first."""
        out, node = [], self.end[word]
        while node:
            out.append(self.token[node])
            node = self.start[node]
        return out[::-1]


class Codec:
    """Encodes texts. Words seen are remembered, up to a bound; an added token never occurs among words, as texts are split there."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.at, self.flat = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def encode(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of whole texts; a null is empty. Words of many texts are looked up, and learnt, at once."""
        total, out, held, owner, size, n = [np.zeros(0, np.int64)], [], [], [], 0, 0

        def flush() -> None:
            nonlocal held, owner, size
            count, ids = self._encode(list(chain.from_iterable(held)))
            ends = np.concatenate(([0], np.cumsum(count)))
            at = np.cumsum([0, *map(len, held)])
            total.append(np.bincount(owner, np.diff(ends[at])).astype(np.int64))
            out.append(ids)
            held, owner, size = [], [], 0

        for text in texts:
            parts = self.vocab.splitter.split(text or "") if self.vocab.splitter else [text or ""]
            for i, part in enumerate(parts):
                for words in [[part]] if i % 2 else self.vocab.words(part):
                    held.append(words)
                    owner.append(n)
                    size += sum(map(len, words))
                    if size >= SLICE_CHARS:
                        flush()
            n += 1
        if held:
            flush()
        counts = np.zeros(n, np.int64)
        for own in total:
            counts[: len(own)] += own
        return np.concatenate(([0], np.cumsum(counts))), np.concatenate(out) if out else np.zeros(0, np.uint32)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, ids)."""
        new = set(words).difference(self.known)
        if len(new) + len(self.known) > CACHE_WORDS:
            self.clear()
            new = set(words)
        if new:
            self._learn(list(new))
        word = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        low, high = self.at[word], self.at[word + 1]
        ends = np.cumsum(high - low)
        return high - low, self.flat[np.repeat(high - ends, high - low) + np.arange(ends[-1] if len(ends) else 0)]

    def _learn(self, words: list[str]) -> None:
        added = self.vocab.added
        raw = [w.encode() for w in words]
        trie = Trie(self.vocab, [r for r, w in zip(raw, words, strict=True) if w not in added])
        own = [[added[w]] if w in added else trie.ids(r) for r, w in zip(raw, words, strict=True)]
        self.known.update(zip(words, range(len(self.at) - 1, len(self.at) - 1 + len(words)), strict=True))
        self.at = np.concatenate((self.at, self.at[-1] + np.cumsum([len(x) for x in own])))
        self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(own), np.uint32)))

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids; bytes that aren't UTF-8 become U+FFFD, ids out of range give nothing."""
        return b"".join([self.vocab.bytes.get(i, b"") for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def read_vocabulary(path: str) -> Vocabulary:
    with open(path, "rb") as f:  # on the driver, which sends the vocabulary on
        return Vocabulary(f.read())


def _udf(spark: SparkSession, model: str, schema: str, rows) -> Column:
    vocab = spark.sparkContext.broadcast(read_vocabulary(os.fspath(model)))  # a vocabulary of fixed size

    @F.arrow_udf(schema)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec(vocab.value)
        for column in batches:
            yield rows(codec, column)

    return run


def _id_lists(codec: Codec, column: pa.Array) -> pa.Array:
    at, ids = codec.encode(x.as_py() for x in column)
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))


def _texts(codec: Codec, column: pa.Array) -> pa.Array:
    return pa.array([codec.decode(x.as_py()) if x.is_valid else None for x in column], pa.string())


def _digests(codec: Codec, column: pa.Array) -> pa.Array:
    """Of id lists: their number, and the SHA-256 of the ids as little-endian 32-bit integers and of the decoded text."""
    out = []
    for x in column:
        ids = x.values.to_numpy(zero_copy_only=False)
        out.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(codec.decode(ids.tolist()).encode()).hexdigest()))
    n, a, b = zip(*out, strict=True) if out else ((), (), ())
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["n", "ids", "text"])


def encode_udf(spark: SparkSession, model: str = MODEL) -> Column:
    """A column function: text to token ids. Null and empty texts have no ids; added tokens in a text are taken as such."""
    return _udf(spark, model, "array<int>", _id_lists)


def decode_udf(spark: SparkSession, model: str = MODEL) -> Column:
    """A column function: token ids to text. Null gives null; ids out of range or null give nothing."""
    return _udf(spark, model, "string", _texts)


def encode_documents(docs: DataFrame, text_col: str = "text", model: str = MODEL) -> DataFrame:
    """Add ids and n_tokens; input columns of these names are replaced, all others come back as they are.

    One row out for each row in, repeated rows too. Null and empty texts have no ids. Texts of any length are
    encoded whole, in stretches that end between words; a single word needs memory of some 100 bytes a byte.
    """
    ids = encode_udf(docs.sparkSession, model)(F.col(text_col))
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("ids", "n_tokens")]
    return docs.select(*others, ids.alias("ids")).select(*[c for c in others], "ids", F.size("ids").alias("n_tokens"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again; one digest row a document."""
    own = own_session(spark, **SMALL_BATCHES)
    digests = _udf(own, MODEL, "struct<n:bigint,ids:string,text:string>", _digests)
    docs = encode_documents(table(own, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", digests(F.col("ids")).alias("d")).select(
        "doc_id", F.col("d.n").alias("n_tokens"), F.col("d.ids").alias("ids_sha256"), F.col("d.text").alias("decoded_sha256")
    )
