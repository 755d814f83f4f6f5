"""SentencePiece encoding and decoding in batched numpy.

A text is normalised as the model says and cut where no piece can reach across: before a space
mark that follows another character, and around characters that the vocabulary lacks, which
become bytes. The distinct words of a batch are encoded once, those of equal length together:

* substring hashes, from prefix sums, probe the sorted keys of the pieces, as long as some piece
  may end with that substring;
* for every end in a word, every piece that ends there is a step from an earlier end, and a
  vectorised maximum over the steps stores the backpointer;
* the steps are walked back from the end of the word.

Words of over LONG characters, of which a batch would hold few, and runs of marks are encoded one by
one: by the merges from a heap, or by Viterbi a character at a time. Either takes little more than
time in proportion, and words of any length are encoded whole.

For a unigram model a step adds the piece's score, and the maximum is Viterbi's. In a BPE model
scores are merge ranks, and their sum says nothing; there the prefix ending at each place has
exactly one last piece, namely the one that its predecessor doesn't merge with or into. So the
step's value is 0 if the pair would stay apart under the merge rules, and minus infinity else,
and the walk gives the merges' own result.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.llm.words import U, buffers, mix, ranges_hash
from siftwork.session import SMALL_BATCHES, own_session, table

#: The public model; the path is read on the driver and its pieces are sent to the workers.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
BASE = U(0x9E3779B97F4A7C15)
MARK_CODE = ord(MARK)
#: Characters worked on at once, at most but for a longer word; words remembered; longest word that is batched.
SLICE_CHARS, CACHE_WORDS, LONG = 500_000, 400_000, 256
BLOCK_CHARS, CACHE_BITS = 300_000, 20
CACHE_SLOTS = 1 << CACHE_BITS
_BETWEEN = re.compile(f"(?<!{MARK}){MARK}")
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


def _char_values(chars: np.ndarray) -> np.ndarray:
    return mix(chars.astype(U) + U(0x51ED27))


def _key(hashes: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    """A substring's key: its hash is spread already, so a product is enough."""
    return (hashes ^ (np.asarray(lengths).astype(U) << U(7))) * U(0xD6E8FEB86659FD93)


class Pieces:
    """A model's pieces, their sorted hash keys and, for BPE, how each piece is merged."""

    def __init__(self, pieces: list[str], scores: np.ndarray, kinds: np.ndarray, bpe: bool, dummy_prefix: bool = True):
        self.pieces, self.scores, self.kinds, self.bpe, self.dummy_prefix = pieces, scores, kinds, bpe, dummy_prefix
        own = np.flatnonzero(np.isin(kinds, (NORMAL, USER)))
        self.by_text = {pieces[i]: int(i) for i in own}
        self.length = np.array([len(p) for p in pieces])
        self.longest = int(self.length[own].max(initial=1))
        powers = np.full(LONG + self.longest + 2, BASE, U)
        powers[0] = 1
        self.up = np.multiply.accumulate(powers)
        powers[1:] = U(pow(int(BASE), -1, 1 << 64))
        self.down = np.multiply.accumulate(powers)
        self.order = np.unique(-scores, return_inverse=True)[1].tolist()
        self.rank = np.where(self.length > 1, -scores.astype(np.float64), -np.inf)
        self.left, self.right = np.full(len(pieces), -1), np.full(len(pieces), -1)
        self.joined: dict[tuple[int, int], int] = {}
        if bpe:
            for p, i in self.by_text.items():
                parts = self.merge(p, last=True) if len(p) > 1 else []
                if len(parts) == 2:
                    self.left[i], self.right[i] = parts
            own = own[(self.length[own] == 1) | (self.left[own] >= 0)]  # the merges never give the others
        self.joined = {}
        size = self.length[own]
        place = _ranges(np.zeros(len(own), np.int64), size)
        chars = _char_values(np.frombuffer("".join(pieces[i] for i in own).encode("utf-32-le"), np.uint32))
        sums = np.concatenate((np.zeros(1, U), np.cumsum(chars * self.up[place], dtype=U)))
        stop = np.repeat(np.cumsum(size), size)
        tails = (sums[stop] - sums[:-1]) * self.down[place]  # the hash from each character of a piece to its end
        self.hash = np.zeros(len(pieces), U)
        self.hash[own] = tails[place == 0]
        keys = _key(self.hash[own], self.length[own])
        order = np.argsort(keys)
        self.keys, self.ids = np.append(keys[order], ~U(0)), np.append(own[order], -1).astype(np.int32)
        top = (self.keys[:-1] >> U(48)).astype(np.int64)
        self.first = np.searchsorted(top, np.arange(1 << 16)).astype(np.int32)
        self.kept = np.zeros(1 << 21, np.uint8)  # 1: some piece ends with this; 3: it is a piece; bits of the key only, so never too few
        self.kept[(_key(tails, stop - np.arange(len(place))) >> U(43)).astype(np.int64)] = 1
        self.kept[(keys >> U(43)).astype(np.int64)] |= 2
        self.known = np.zeros(0x110000, bool)
        self.known[[ord(p) for p in self.by_text if len(p) == 1]] = True
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(pieces) if kinds[i] == BYTE}
        self.unknown = int(np.flatnonzero(kinds == UNKNOWN)[0]) if (kinds == UNKNOWN).any() else 0
        self.pairs = self.stay = None
        flat = [self._bytes(i) for i in range(len(pieces))]
        self.out_at = np.concatenate(([0], np.cumsum([len(b) for b in flat])))
        self.out = np.frombuffer(b"".join(flat), np.uint8)

    def _bytes(self, i: int) -> bytes:
        if self.kinds[i] == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        if self.kinds[i] in (CONTROL, UNUSED):
            return b""
        return " ⁇ ".encode() if self.kinds[i] == UNKNOWN else self.pieces[i].replace(MARK, " ").encode()

    def merge(self, word: str, last: bool = False) -> list[int]:
        """The merges one by one, the best score first and then the leftmost, from a heap: n log n for any word.

        last: without the merge that gives word itself.
        """
        ids = [self.by_text[c] for c in word]
        n, joined = len(ids), self.joined
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def both(k: int) -> int:
            pair = ids[k], ids[after[k]]
            got = joined.get(pair)
            if got is None:
                got = joined[pair] = self.by_text.get(self.pieces[pair[0]] + self.pieces[pair[1]], -1)
            return got

        order = self.order
        heap = [(order[x] << 40) + k for k in range(n - 1) if (x := both(k)) >= 0]
        heapq.heapify(heap)
        left = n
        while heap and not (last and left == 2):
            what = heapq.heappop(heap)
            k = what & ((1 << 40) - 1)
            if ids[k] < 0 or after[k] >= n or (x := both(k)) < 0 or order[x] != what >> 40:
                continue
            gone = after[k]
            ids[k], ids[gone], after[k] = x, -1, after[gone]
            left -= 1
            if after[k] < n:
                before[after[k]] = k
            for at in (before[k], k):
                if at >= 0 and after[at] < n and (x := both(at)) >= 0:
                    heapq.heappush(heap, (order[x] << 40) + at)
        if len(joined) > 500_000:
            joined.clear()
        return [i for i in ids if i >= 0]

    def walk(self, word: str) -> list[int]:
        """Viterbi over one long word, a character after the other."""
        value, back = [0.0], [0]
        for end in range(1, len(word) + 1):
            best, at = -np.inf, -1
            for k in range(1, min(end, self.longest) + 1):
                i = self.by_text.get(word[end - k : end])
                if i is not None and value[end - k] + self.scores[i] > best:
                    best, at = value[end - k] + self.scores[i], i
            value.append(best)
            back.append(at)
        out, end = [], len(word)
        while end:
            out.append(back[end])
            end -= len(self.pieces[back[end]])
        return out[::-1]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these keys, looked up among the sorted ones; -1 for none."""
        out = np.full(len(keys), -1, np.int32)
        rest = np.flatnonzero(self.kept[(keys >> U(43)).astype(np.int64)] & 2)
        keys = keys[rest]
        at = self.first[(keys >> U(48)).astype(np.int64)]
        while len(rest):
            here = self.keys[at]
            out[rest] = np.where(here == keys, self.ids[at], -1)
            more = np.flatnonzero(here < keys)
            rest, keys, at = rest[more], keys[more], at[more] + 1
        return out

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces a and b side by side stay as they are under the merges; remembered by pair."""
        if self.pairs is None:
            self.pairs, self.stay = np.full(1 << 21, -1), np.zeros(1 << 21, bool)
        pair = a.astype(np.int64) * len(self.pieces) + b
        slot = ((pair.astype(U) * BASE) >> U(43)).astype(np.int64)
        new = np.flatnonzero(self.pairs[slot] != pair)
        out = self.stay[slot]
        if len(new):
            pairs, back = np.unique(pair[new], return_inverse=True)
            good = self._apart(pairs // len(self.pieces), pairs % len(self.pieces))
            out[new] = good[back]
            at = ((pairs.astype(U) * BASE) >> U(43)).astype(np.int64)
            at, one = np.unique(at, return_index=True)
            self.pairs[at], self.stay[at] = pairs[one], good[one]
        return out

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces a and b side by side stay as they are under the merges.

        The merges that made them are undone from the latest to the first; at each stage the
        two parts that touch must not merge before the merge just undone.
        """
        out = np.ones(len(a), bool)
        limit, fair = np.full(len(a), np.inf), np.zeros(len(a), bool)
        on, a, b = np.arange(len(a)), a.copy(), b.copy()
        while len(on):
            x, y = a[on], b[on]
            both = self.find(_key(self.hash[x] + self.up[self.length[x]] * self.hash[y], self.length[x] + self.length[y]))
            when = np.where(both >= 0, self.rank[both], np.inf)
            broken = (when < limit[on]) | (fair[on] & (when == limit[on]) & np.isfinite(when)) | ((both >= 0) & np.isinf(limit[on]))
            out[on[broken]] = False
            left, right = self.rank[x], self.rank[y]
            go = ~broken & ~(np.isinf(left) & np.isinf(right))
            on, x, y, left, right = on[go], x[go], y[go], left[go], right[go]
            first = left > right
            limit[on], fair[on] = np.maximum(left, right), ~first
            a[on], b[on] = np.where(first, self.right[x], x), np.where(first, y, self.left[y])
        return out

    def encode_parts(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the parts codes[start:end]: words of known characters, those of equal length together, and others."""
        sizes, groups = end - start, []
        first, second = codes[start], codes[np.minimum(start + 1, end - 1)]
        runs = self.bpe & (sizes > 1) & (first == MARK_CODE) & (second == MARK_CODE)
        special = np.flatnonzero((~self.known[first] & (sizes == 1)) | runs | (sizes > LONG))
        if len(special):
            own = [self._special(codes[start[i] : end[i]].tobytes().decode("utf-32-le")) for i in special]
            groups.append((special, np.array([len(x) for x in own]), np.concatenate(own)))
        plain = np.ones(len(start), bool)
        plain[special] = False
        plain = np.flatnonzero(plain)
        plain = plain[np.argsort(sizes[plain], kind="stable")]
        bounds = np.searchsorted(np.cumsum(sizes[plain]), np.arange(1, int(sizes[plain].sum()) // BLOCK_CHARS + 1) * BLOCK_CHARS)
        for rows in np.split(plain, bounds):
            if len(rows):
                groups.append((rows, *self._lattice(codes, start[rows], sizes[rows])))
        n = np.zeros(len(start), np.int64)
        for rows, count, _ in groups:
            n[rows] = count
        ends = np.concatenate(([0], np.cumsum(n)))
        flat = np.zeros(ends[-1], np.int32)
        for rows, _, ids in groups:
            flat[_ranges(ends[rows], ends[rows + 1])] = ids
        return ends, flat

    def _special(self, part: str) -> np.ndarray:
        """Bytes of a character that the vocabulary lacks; a part too long for a batch; or what only
        the merges can order, as runs of marks hold pieces of equal rank."""
        if self.known[ord(part[0])]:
            return np.array(self.merge(part) if self.bpe else self.walk(part), np.int32)
        return np.array([self.byte[b] for b in part.encode()] if self.byte else [self.unknown], np.int32)

    def _lattice(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(counts, ids) of words, given by length: those of one length are side by side, and all advance together.

        Word w has the nodes base[w]..base[w] + size[w], the last of which ends it.
        """
        base = np.cumsum(size + 1) - (size + 1)
        place = _ranges(np.zeros(len(size), np.int64), size + 1)
        inner = np.flatnonzero(place)
        sums = np.zeros(len(place), U)
        sums[inner] = _char_values(codes[_ranges(start, start + size)]) * self.up[place[inner] - 1]
        np.cumsum(sums, out=sums)
        ends, widths, found, node = [], [], [], inner
        for k in range(1, self.longest + 1):  # node: where some piece may end with the k characters that end here
            node = node[place[node] >= k]
            if not len(node):
                break
            keys = _key((sums[node] - sums[node - k]) * self.down[place[node] - k], k)
            kept = self.kept[(keys >> U(43)).astype(np.int64)]
            may = np.flatnonzero(kept & 2)
            piece = self.find(keys[may])
            real = np.flatnonzero(piece >= 0)
            ends.append(node[may[real]])
            widths.append(np.full(len(real), k, np.int32))
            found.append(piece[real])
            node = node[kept > 0]
        end, width, piece = np.concatenate(ends), np.concatenate(widths), np.concatenate(found)
        order = np.lexsort((end, place[end]))
        end, width, piece = end[order], width[order], piece[order]
        bounds = np.searchsorted(place[end], np.arange(1, int(size[-1]) + 2))
        last, back, best = np.full(len(place), -1, np.int32), np.zeros(len(place), np.int32), np.where(place > 0, -np.inf, 0.0)
        for at in range(1, len(bounds)):
            own = slice(bounds[at - 1], bounds[at])
            e, w, p = end[own], width[own], piece[own]
            if self.bpe:
                value = np.where(w == at, 0.0, -np.inf)
                rest = np.flatnonzero(w < at)
                value[rest[self.apart(last[e[rest] - w[rest]], p[rest])]] = 0.0
            else:
                value = best[e - w] + self.scores[p]
            if len(e):
                first = np.flatnonzero(np.append(True, e[1:] != e[:-1]))
                best[e[first]] = np.maximum.reduceat(value, first)
                win = np.flatnonzero((value == best[e]) & (value > -np.inf))
                last[e[win]], back[e[win]] = p[win], w[win]
        count, steps, word, node = np.zeros(len(size), np.int64), [], np.arange(len(size)), base + size
        while len(word):
            steps.append((word, last[node]))
            count[word] += 1
            node = node - back[node]
            on = place[node] > 0
            word, node = word[on], node[on]
        stop, out = np.cumsum(count), np.zeros(count.sum(), np.int32)
        for k, (word, ids) in enumerate(steps, 1):
            out[stop[word] - k] = ids
        return count, out

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a text from its ids, without the mark put before it."""
        raw = self.out[_ranges(self.out_at[ids], self.out_at[ids + 1])].tobytes()
        return raw[1:] if self.dummy_prefix and raw[:1] == b" " else raw


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """start[0]..end[0]-1, start[1]..end[1]-1 and so on."""
    n = end - start
    total = np.cumsum(n)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(start - (total - n), n)


@lru_cache(maxsize=2)
def read_model(path: str = MODEL) -> Pieces:
    """Pieces of a model file. Models with a normaliser of their own aren't read: only the identity."""
    with open(path, "rb") as f:
        data = f.read()
    pieces, scores, kinds, kind, rule = [], [], [], 1, {}
    for field_, value in _fields(data):
        if field_ == 1:
            own = dict(_fields(value))
            pieces.append(own[1].decode())
            scores.append(np.frombuffer(own.get(2, b"\0\0\0\0"), "<f4")[0])
            kinds.append(own.get(3, NORMAL))
        elif field_ == 2:
            kind = dict(_fields(value)).get(3, 1)
        elif field_ == 3:
            rule = dict(_fields(value))
    if rule.get(2) or kind not in (1, 2) or rule.get(4, 1):
        raise ValueError("only BPE and unigram models with the identity as normaliser and white space kept are read")
    return Pieces(pieces, np.array(scores), np.array(kinds), kind == 2, bool(rule.get(3, 1)))


class Codec:
    """Encodes texts, remembering words: a table of fixed size by hash, compared character by character."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.seen, self.word = np.zeros(CACHE_SLOTS, U), np.full(CACHE_SLOTS, -1, np.int32)
        self.clear()

    def clear(self) -> None:
        self.word[:] = -1
        self.at, self.flat = np.zeros(1, np.int64), np.zeros(0, np.int32)
        self.char_at, self.chars = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def stretches(self, text: str) -> Iterator[str]:
        """A text with its marks, in stretches of bounded length that end where no piece can reach across."""
        text = MARK * self.pieces.dummy_prefix + text.replace(" ", MARK)
        at = 0
        while len(text) - at > SLICE_CHARS:
            cut = text.rfind(MARK, at + 1, at + SLICE_CHARS)
            while cut > at and text[cut - 1] == MARK:
                cut -= 1
            if cut <= at:
                found = _BETWEEN.search(text, at + 1)
                cut = found.start() if found else len(text)
            yield text[at:cut]
            at = cut
        if at < len(text):
            yield text[at:]

    def encode(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of texts, in slices of bounded length. None is empty."""
        counts, out, held, owner, size, n = [], [], [], [], 0, 0

        def flush() -> None:
            nonlocal held, owner, size
            count, ids = self._encode(held)
            counts.append((owner, count))
            out.append(ids)
            held, owner, size = [], [], 0

        for text in texts:
            for part in self.stretches(text) if text else ():
                if held and size + len(part) > SLICE_CHARS:
                    flush()
                held.append(part)
                owner.append(n)
                size += len(part)
            n += 1
        if held:
            flush()
        total = np.zeros(n, np.int64)
        for rows, count in counts:
            np.add.at(total, rows, count)
        return np.concatenate(([0], np.cumsum(total))), np.concatenate(out) if out else np.zeros(0, np.int32)

    def _encode(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each stretch, ids)."""
        codes = np.frombuffer("".join(stretches).encode("utf-32-le"), np.uint32)
        first = np.concatenate(([0], np.cumsum([len(x) for x in stretches])))
        mark, odd = codes == MARK_CODE, ~self.pieces.known[codes]
        new = odd | mark
        new[1:] = (mark[1:] & ~mark[:-1]) | odd[1:] | odd[:-1]
        new[first[:-1]] = True
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(codes))
        hashes = ranges_hash(_char_values(codes), start, end, BASE)
        slot = (hashes >> U(64 - CACHE_BITS)).astype(np.int64)
        word = np.where(self.seen[slot] == hashes, self.word[slot], -1)
        rest = np.flatnonzero(word < 0)
        if len(rest):
            _, one, back = np.unique(hashes[rest], return_index=True, return_inverse=True)
            if len(self.at) + len(one) > CACHE_WORDS:
                self.clear()
                if len(one) > CACHE_WORDS // 2:  # more new words than should be remembered
                    at, flat = self.pieces.encode_parts(codes, start, end)
                    return self._gather(at, flat, np.arange(len(start)), start, first)
                return self._encode(stretches)
            word[rest] = len(self.at) - 1 + back
            self._learn(codes, start[rest[one]], end[rest[one]], hashes[rest[one]], slot[rest[one]])
        lost = self._other(word, codes, end - start)
        if len(lost):  # words of one hash that aren't the same
            word[lost] = np.arange(len(lost)) + len(self.at) - 1
            self._learn(codes, start[lost], end[lost], hashes[lost], slot[lost])
        return self._gather(self.at, self.flat, word, start, first)

    def _gather(self, at: np.ndarray, flat: np.ndarray, word: np.ndarray, start: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = at[word], at[word + 1]
        total = np.concatenate(([0], np.cumsum(high - low)))
        return np.diff(total[np.searchsorted(start, first)]), flat[_ranges(low, high)]

    def _other(self, word: np.ndarray, codes: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Which parts aren't the remembered words, by their characters. The parts follow each other in codes."""
        low = self.char_at[word]
        bad = self.char_at[word + 1] - low != size
        if bad.any():
            low = np.where(bad, 0, low)
        at = np.minimum(_ranges(low, low + size), len(self.chars) - 1)
        differ = np.flatnonzero(codes != self.chars[at])
        bad[np.searchsorted(np.cumsum(size), differ, "right")] = True
        return np.flatnonzero(bad)

    def _learn(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray, slot: np.ndarray) -> None:
        at, flat = self.pieces.encode_parts(codes, start, end)
        self.seen[slot], self.word[slot] = hashes, np.arange(len(start)) + len(self.at) - 1
        self.at, self.flat = np.concatenate((self.at, self.at[-1] + at[1:])), np.concatenate((self.flat, flat))
        self.char_at = np.concatenate((self.char_at, self.char_at[-1] + np.cumsum(end - start)))
        self.chars = np.concatenate((self.chars, codes[_ranges(start, end)]))


def encode_column(column: pa.Array, codec: Codec) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, ids) of a string column. Null is empty."""
    return codec.encode(x.as_py() for x in column)


def encode_udf(spark: SparkSession, model: str = MODEL) -> Column:
    """A column function: text to token ids. Null and empty texts have no ids."""
    shared = spark.sparkContext.broadcast(read_model(model))  # a vocabulary of fixed size

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec(shared.value)
        for column in batches:
            at, ids = encode_column(column, codec)
            yield pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))

    return encode


def decode_udf(spark: SparkSession, model: str = MODEL) -> Column:
    """A column function: token ids to text. Null gives null; ids out of range or null are left out."""
    shared = spark.sparkContext.broadcast(read_model(model))

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            values = column.flatten().cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
            ends = np.concatenate(([0], np.cumsum(np.array([len(x) if x.is_valid else 0 for x in column], np.int64))))
            out = []
            for r in range(len(column)):
                own = values[ends[r] : ends[r + 1]]
                own = own[(own >= 0) & (own < len(shared.value.pieces))]
                out.append(shared.value.decode(own).decode("utf-8", "replace") if column[r].is_valid else None)
            yield pa.array(out, pa.string())

    return decode


def round_trip_udf(spark: SparkSession, model: str = MODEL) -> Column:
    """A column function: text to its ids and whether decoding these gives the text again, marks as spaces."""
    shared = spark.sparkContext.broadcast(read_model(model))

    @F.arrow_udf("struct<ids:array<int>,same:boolean>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec(shared.value)
        for column in batches:
            at, ids = encode_column(column, codec)
            start, data = buffers(column)
            same = [
                codec.pieces.decode(ids[at[r] : at[r + 1]]) == data[start[r] : start[r + 1]].tobytes().replace(MARK.encode(), b" ")
                for r in range(len(column))
            ]
            yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids)), pa.array(same, pa.bool_())], ["ids", "same"])

    return both


def encode_documents(docs: DataFrame, text_col: str = "text", model: str = MODEL) -> DataFrame:
    """Add ids and n_tokens; input columns of these names are replaced. One row out for each row in.

    Null and empty texts have no ids. Texts of any length are encoded whole.
    """
    encode = encode_udf(docs.sparkSession, model)
    base = docs.withColumn("__ids", encode(F.col(text_col)))
    return base.select(
        *[F.col(c) for c in docs.columns if c not in ("ids", "n_tokens")], F.col("__ids").alias("ids"), F.size("__ids").alias("n_tokens")
    )


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether decoding them gives the text again (its marks as spaces)."""
    own = own_session(spark, **SMALL_BATCHES)
    both = round_trip_udf(own)
    docs = table(own, sf_dir, "documents").select("doc_id", both(F.col("text")).alias("b"))
    return docs.select("doc_id", F.size("b.ids").alias("n_tokens"), F.col("b.ids").alias("ids"), F.col("b.same").alias("round_trip"))
