"""Embedding near-duplicates by product quantisation over coarse inverted lists.

1. Equal vectors are one class with a multiplicity; classes are normalised.
2. Coarse centroids and, for residuals, one codebook for each subspace are fitted on a bounded
   sample. Every class is put in its nearest centroid's list with a code and the exact length of
   its coding error.
3. A class x near c1 probes the list of c2 if d(x,c2)^2 - d(x,c1)^2 <= 2 * radius * |c1 - c2|: the
   plane between the centroids is nearer than a link can cross. That holds for every link,
   whichever way its step goes, so no list that may hold one is left out. In many dimensions that is a
   large part of all lists, whatever their number, so that exact links cost comparisons that grow with the
   square of the classes. A caller who can do with most links gives a smaller `reach`: the part of the
   radius that the plane may be away.
4. In a list, asymmetric distances come from lookup tables: one table of products a query serves
   every list, as |x - c - b|^2 = |x - c|^2 - 2 x.b + (2 c.b + |b|^2), the last a number kept with
   each member. A member stays a candidate if its distance is at most radius + coding error, which
   no link exceeds. Candidates are ranked again by exact cosine in double precision.
5. Lists are packed into tiles and split where they are larger. A tile is one row, and every two tiles meet once,
   in a join without a shuffle whose tasks read both from the checkpoint folder: comparisons grow with the
   square of the classes, disk with the classes. A task emits a count for a class that links and an edge
   where a class's component in the task changes, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from siftwork.llm.components import components
from siftwork.llm.skew import dealt_join
from siftwork.llm.vectors import kmeans, nearest_row, squared, takes_part, unit
from siftwork.llm.words import arrow_rows
from siftwork.session import cut, stored, table

#: Rows the centroids and codebooks are fitted on; rows of a tile, at least and at most; rows a list should
#: hold; lists, at most, as centroids are fitted on a bounded sample: longer lists are split over tiles.
SAMPLE, LEAST_BLOCK, BLOCK, LIST, CELLS = 16_384, 1024, 16_384, 64, 1024
#: Bytes of a tile's vectors, at most; partitions of tiles that meet each other, from which on one holds up to HELD tiles.
BYTES, GRID, HELD = 16 << 20, 16, 16
SUBSPACES, CODES = 8, 256
SLACK = 1e-4  # tables are in single precision
#: A tile as a row: its number and, as bytes, what each member has.
PACKED = ["tile", "rep", "mult", "cell", "codes", "most", "vec"]


class Quantiser:
    """Coarse centroids and residual codebooks."""

    def __init__(self, sample: np.ndarray, cells: int, least: float, reach: float = 1.0):
        sample = unit(sample)
        dim = sample.shape[1]
        self.least, self.radius, self.reach = least, float(np.sqrt(max(0.0, 2 - 2 * least))), reach
        self.centers = kmeans(sample, cells, 8)
        rest = sample - self.centers[nearest_row(sample, self.centers)]
        self.parts = np.array_split(np.arange(dim), min(SUBSPACES, dim))
        self.books = [kmeans(rest[:8192, p], CODES, 5) for p in self.parts]
        self.apart = np.sqrt(squared(self.centers, self.centers))

    def encode(self, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of members of cells, coding error, and the member's own part of the distance."""
        rest = x - self.centers[cell]
        codes = np.stack([nearest_row(rest[:, p], b) for p, b in zip(self.parts, self.books, strict=True)], 1).astype(np.uint8)
        back = np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], 1)
        own = 2 * (self.centers[cell] * back).sum(1) + (back * back).sum(1)
        return codes, np.sqrt(((rest - back) ** 2).sum(1)), own

    def probes(self, far: np.ndarray, cells: np.ndarray, near: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Which of cells each row probes; far: squared distances to them; near, own: the nearest cell of all and its distance."""
        return far - own[:, None] <= 2 * self.reach * self.radius * self.apart[near][:, cells] + 1e-9

    def table(self, q: np.ndarray) -> list[np.ndarray]:
        """Products of every code with each row of -2 q, by subspace: a row for a code."""
        return [(b @ (-2 * q[:, p].T)).astype(np.float32) for p, b in zip(self.parts, self.books, strict=True)]


class Tile:
    """Members of some lists."""

    def __init__(self, model: Quantiser, x: np.ndarray, ids: np.ndarray, mult: np.ndarray, cell: np.ndarray, codes: np.ndarray, most: np.ndarray):
        self.model, self.x, self.ids, self.mult, self.cell, self.codes, self.most = model, x, ids, mult, cell, codes, most
        self.far = ((x - model.centers[cell]) ** 2).sum(1)
        order = np.argsort(cell, kind="stable")
        self.lists, first = np.unique(cell[order], return_index=True)
        self.members = np.split(order, first[1:])

    def links(self, q: np.ndarray, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(i, j): rows of q and members that link, found among table-lookup candidates in the lists that q probes."""
        model, left, right = self.model, [np.zeros(0, int)], [np.zeros(0, int)]
        for s in range(0, len(q), 1024):
            part = q[s : s + 1024]
            room = np.empty((2, 128, len(part)), np.float32)
            away = squared(part, model.centers[self.lists])
            probed = model.probes(away, self.lists, near[s : s + 1024], far[s : s + 1024])
            away = np.where(probed, away, np.inf).T.astype(np.float32)
            tables = model.table(part)
            for k in np.flatnonzero(probed.any(0)):
                for m in np.split(self.members[k], range(128, len(self.members[k]), 128)):  # so that sums stay in a cache
                    codes, total, more = self.codes[m], room[0, : len(m), : len(part)], room[1, : len(m), : len(part)]
                    np.take(tables[0], codes[:, 0], axis=0, out=total, mode="clip")
                    for i in range(1, len(tables)):
                        total += np.take(tables[i], codes[:, i], axis=0, out=more, mode="clip")
                    total += away[k]
                    j, i = np.divmod(np.flatnonzero(total <= self.most[m, None]), len(part))
                    for t in range(0, len(i), 50_000):
                        a, b = i[t : t + 50_000], m[j[t : t + 50_000]]
                        good = np.einsum("nd,nd->n", part[a], self.x[b]) >= model.least
                        left.append(a[good] + s)
                        right.append(b[good])
        return np.concatenate(left), np.concatenate(right)


class Found:
    """Of each class of the tiles that meet in a task: its links so far, and the smallest class seen in its component."""

    def __init__(self):
        self.ids, self.n, self.lead = {}, {}, {}

    def meet(self, at: int, tile: Tile, to: int, other: Tile) -> tuple[np.ndarray, np.ndarray]:
        """Links between two tiles, or in one where at = to: (a, b), classes that are in one component."""
        for k, x in ((at, tile), (to, other)):
            if k not in self.ids:
                self.ids[k], self.n[k], self.lead[k] = x.ids, np.zeros(len(x.ids), np.int64), x.ids.copy()
        i, j = tile.links(other.x, other.cell, other.far)
        differ = other.ids[i] != tile.ids[j]
        i, j = i[differ], j[differ]
        np.add.at(self.n[to], i, tile.mult[j])
        if at != to:  # in one tile a link is found from both its ends
            np.add.at(self.n[at], j, other.mult[i])
        a, b = tile_leads(i, j, self.lead[to], self.lead[at])
        edges = [np.zeros((0, 2), np.int64)]
        for k, lead in ((to, a), (at, b)):
            moved = np.flatnonzero(lead < self.lead[k])
            edges.append(np.stack((self.lead[k][moved], lead[moved]), 1))
            self.lead[k] = np.minimum(lead, self.lead[k])
        edges = np.unique(np.concatenate(edges), axis=0)
        return edges[:, 0], edges[:, 1]

    def counts(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(class, links), where there are any."""
        for k, n in self.n.items():
            linked = np.flatnonzero(n)
            yield self.ids[k][linked], n[linked]


def tile_leads(i: np.ndarray, j: np.ndarray, q_id: np.ndarray, x_id: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id in each row's component by these links."""
    a, b = q_id.copy(), x_id.copy()
    while True:
        old = a.copy(), b.copy()
        np.minimum.at(a, i, b[j])
        np.minimum.at(b, j, a[i])
        if (a == old[0]).all() and (b == old[1]).all():
            return a, b


def embedding_near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.95, reach: float = 1.0) -> DataFrame:
    """(id_col, n_links, component_id, kept), a row for each input row.

    Vectors link at a cosine of `least` or more, in double precision. Null, empty or zero
    vectors and those with null or non-finite components link with nothing and are kept; so are
    rows with a null id, whose component is null. Vectors of different lengths don't link.
    Repeated rows count as vectors of their own. Ties go to the smaller id. With a reach of 1 no link
    is missed; below it the lists that a vector probes are fewer, and links found are still exact.
    """
    kind = vectors.schema[vec_col].dataType.elementType
    double = not isinstance(kind, FloatType)
    vec = F.col(vec_col).cast("array<double>") if double else F.col(vec_col)
    named = vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))
    takes = F.col("id").isNotNull() & takes_part(F.col("vec"))
    good = named.filter(takes)
    uniq = good.groupBy("vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("mult"))
    uniq = stored(
        uniq.select("rep", "mult", F.size("vec").alias("dim"), *_digest("vec"), "vec").mapInArrow(
            _pack, "rep long, mult long, dim int, h1 long, h2 long, vec binary"
        )
    )
    found = None
    for dim, n in sorted(tuple(r) for r in uniq.groupBy("dim").count().collect()):  # a row for each length of vector
        own = _tiles(uniq.filter(F.col("dim") == dim), dim, n, double, least, reach)
        found = own if found is None else found.unionByName(own)
    if found is None:
        found = named.sparkSession.createDataFrame([], "a long, n long, b long")
    found = stored(found)
    counts = found.filter("n > 0").groupBy("a").agg(F.sum("n").alias("n"))
    joined = components(found, "a", "b")
    reps = (
        uniq.select("rep", "mult", "h1", "h2")
        .join(counts, F.col("rep") == F.col("a"), "left")
        .join(joined, F.col("rep") == F.col("node"), "left")
        .select("h1", "h2", "mult", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    )
    linked = dealt_join(good.select("id", *_digest("vec")), reps, ["h1", "h2"], "mult", uniq.select("h1", "h2", "mult"))
    alone = named.filter(~takes).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.select("id", "n_links", "component").unionByName(alone).select(
        F.col("id").alias(id_col),
        "n_links",
        F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"),
    )


def _digest(vec: str) -> tuple[Column, Column]:
    """128 hash bits of a vector, by which its rows meet their class again."""
    return F.xxhash64(vec).alias("h1"), F.xxhash64(F.lit(7), vec).alias("h2")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes: in files they are smaller than lists."""
    for batch in batches:
        at = batch.schema.get_field_index("vec")
        yield batch.set_column(at, "vec", pa.array([x.tobytes() for x in _split(batch.column(at))], pa.binary()))


def _split(lists: pa.Array) -> list[np.ndarray]:
    return np.split(lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy())[:-1]) if len(lists) else []


def _unpack(packed: list[bytes], double: bool, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed), np.float64 if double else np.float32).astype(np.float64).reshape(-1, dim)


def _tiles(uniq: DataFrame, dim: int, n: int, double: bool, least: float, reach: float) -> DataFrame:
    """(a, n, b): links a class has in a task, and another class of its component."""
    spark = uniq.sparkSession
    cells = int(min(CELLS, max(1, n // LIST)))
    few = F.xxhash64("rep") <= min(2**63 - 1, 2**65 * SAMPLE // n - 2**63)  # twice the sample, so that not all is sorted
    sample = uniq.filter(few).select("rep", "vec").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).toArrow()
    sample = _unpack(sample.column("vec").to_pylist(), double, dim)
    model = spark.sparkContext.broadcast(Quantiser(sample, cells, least, reach))

    def rows(batch: pa.RecordBatch) -> np.ndarray:
        return unit(_unpack(arrow_rows(batch, "vec").to_pylist(), double, dim))

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many classes a cell has."""
        own = np.zeros(cells, np.int64)
        for batch in batches:
            own += np.bincount(nearest_row(rows(batch), model.value.centers), minlength=cells)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(own).astype(np.int32)), pa.array(own[own > 0])], names=["cell", "n"])

    sizes = uniq.select("vec").mapInArrow(sized, "cell int, n long").groupBy("cell").agg(F.sum("n"))
    sizes = sorted(tuple(r) for r in sizes.collect())  # a row for each of CELLS at most
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    block = max(1, min(BLOCK, BYTES // (8 * dim), max(LEAST_BLOCK, -(-n // parts))))
    first, many, filled, tile = np.zeros(cells, np.int64), np.ones(cells, np.int64), 0, 0  # of each cell: its first tile, and how many
    for c, size in sizes:
        many[c] = -(-size // block)
        share = -(-size // many[c])
        if filled + share > block:
            tile, filled = tile + 1, 0
        first[c] = tile
        tile, filled = tile + many[c] - 1, share if many[c] > 1 else filled + share
    tiles = int(tile) + 1
    grid = min(tiles, max(GRID, -(-tiles // HELD)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep = arrow_rows(batch, "rep")
            cell = nearest_row(rows(batch), model.value.centers)
            spread = (rep.to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            to = first[cell] + spread.astype(np.int64) % many[cell]
            yield pa.RecordBatch.from_arrays(
                [pa.array(to.astype(np.int32)), pa.array(cell.astype(np.int32)), rep, arrow_rows(batch, "mult"), arrow_rows(batch, "vec")],
                names=["tile", "cell", "rep", "mult", "vec"],
            )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each tile."""
        at, held = None, []
        for batch in batches:
            tile = arrow_rows(batch, "tile").to_numpy()
            edges = [0, *(np.flatnonzero(tile[1:] != tile[:-1]) + 1).tolist(), len(batch)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b > a and tile[a] != at:
                    if held:
                        yield packed(at, held)
                    at, held = int(tile[a]), []
                held.append(batch.slice(a, b - a))
        if held:
            yield packed(at, held)

    def packed(at: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        own = pa.Table.from_batches(held)
        vec = own.column("vec").to_pylist()
        codes, error, part = model.value.encode(unit(_unpack(vec, double, dim)), cell := own.column("cell").to_numpy())
        most = ((model.value.radius + error) ** 2 - part + SLACK).astype(np.float32)
        parts = [own.column("rep").to_numpy(), own.column("mult").to_numpy(), cell, codes, most]
        columns = [pa.array([x.tobytes()], pa.binary()) for x in parts]
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), *columns, pa.array([b"".join(vec)], pa.binary())], names=PACKED)

    def build(row: dict, side: str) -> Tile:
        ids, mult, cell, codes, most = (np.frombuffer(row[side + c], k) for c, k in zip(PACKED[1:6], (np.int64, np.int64, np.int32, np.uint8, np.float32), strict=True))
        return Tile(model.value, unit(_unpack([row[side + "vec"]], double, dim)), ids, mult, cell, codes.reshape(len(ids), -1), most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, at, held = Found(), None, None
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1).to_pylist()[0]
                if row["tile"] != at:
                    at, held = row["tile"], build(row, "")
                a, b = found.meet(at, held, row["o_tile"], held if row["o_tile"] == at else build(row, "o_"))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(np.zeros(len(a), np.int64)), pa.array(b)], names=["a", "n", "b"])
        for a, n in found.counts():
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(n), pa.array(a)], names=["a", "n", "b"])

    dealt = uniq.select("rep", "mult", "vec").mapInArrow(place, "tile int, cell int, rep long, mult long, vec binary")
    dealt = dealt.repartitionById(grid, F.pmod("tile", F.lit(grid))).sortWithinPartitions("tile")
    held = cut(dealt.mapInArrow(gather, "tile int, rep binary, mult binary, cell binary, codes binary, most binary, vec binary"))
    other = held.select([F.col(c).alias("o_" + c) for c in held.columns]).hint("shuffle_replicate_nl")
    ahead = 2 * F.pmod(F.col("o_tile") - F.col("tile"), F.lit(tiles))  # of two tiles the one less than half the circle ahead is the other
    once = (ahead < tiles) | ((ahead == tiles) & (F.col("tile") < F.col("o_tile")))
    return held.join(other, once).mapInArrow(run, "a long, n long, b long")


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return embedding_near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


ORACLE = """
WITH RECURSIVE good AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
  ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), counted AS (
  SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM least LEFT JOIN counted USING (vec_id)
"""
