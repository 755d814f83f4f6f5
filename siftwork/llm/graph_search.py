"""Approximate nearest neighbours over robust-pruned directed graphs, one for each shard.

Equal vectors are one node, with their smallest ids attached, so that copies can't fill a node's
edges. Nodes are dealt to shards of bounded size by hash. A shard's graph is built once, and the
queries stream past it in blocks:

* greedy searches from the medoid propose a node's neighbours;
* relaxed distance pruning keeps an edge only if no kept edge is clearly nearer to its end, and
  edges are also offered backwards;
* a beam search finds each query's nearest nodes. A beam that has room for the whole shard is the
  whole shard, for which no graph is needed.

Distances of what is found are exact, in double precision, and shards' results merge by them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwork.llm.tiles import stream_tiles
from siftwork.llm.vectors import matrix, takes_part
from siftwork.llm.words import arrow_rows
from siftwork.session import cut, table

SHARD, DEGREE, BUILD_BEAM, BEAM, RELAX, GROUP, AHEAD = 8192, 32, 40, 128, 1.2, 256, 8
#: Edges a node may have while the graph is built: it is pruned to DEGREE when they are full, and at the end.
ROOM = 40


def _near(x: np.ndarray, norm: np.ndarray, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances less the query's own norm; ids: a row of nodes for each query."""
    return norm[ids] - 2 * np.einsum("qrd,qd->qr", x[ids], q)


def beam_search(x: np.ndarray, norm: np.ndarray, edges: np.ndarray, entry: np.ndarray, q: np.ndarray, beam: int) -> tuple:
    """Node ids and distances of the best `beam` nodes found for each row of q. edges: -1 is no edge."""
    rows = np.arange(len(q))[:, None]
    seen = np.zeros((len(q), len(x) + 1), bool)
    seen[:, -1] = True  # where edges are -1
    ids = np.full((len(q), beam), -1)
    far = np.full((len(q), beam), np.inf, np.float32)
    start = np.unique(entry)[:beam]
    ids[:, : len(start)] = start
    far[:, : len(start)] = norm[start][None, :] - 2 * q @ x[start].T
    seen[:, start] = True
    done = np.ones((len(q), beam), bool)
    done[:, : len(start)] = False
    active = np.arange(len(q))
    while len(active):
        own = np.where(done[active], np.inf, far[active])
        best = np.argpartition(own, AHEAD, axis=1)[:, :AHEAD]
        open_ = np.isfinite(np.take_along_axis(own, best, 1))
        done[active[:, None], best] = True
        nodes = np.where(open_, ids[active[:, None], best], -1)
        new = np.where(nodes[:, :, None] >= 0, edges[nodes], -1).reshape(len(active), -1)
        new.sort(axis=1)
        fresh = ~seen[active[:, None], new]
        fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
        seen[active[:, None], new] = True
        width = int(fresh.sum(1).max(initial=0))
        if width:
            order = np.argsort(~fresh, axis=1, kind="stable")[:, :width]
            new, fresh = np.take_along_axis(new, order, 1), np.take_along_axis(fresh, order, 1)
            got = np.where(fresh, _near(x, norm, q[active], np.where(fresh, new, 0)), np.inf).astype(np.float32)
            all_far, all_ids = np.concatenate((far[active], got), 1), np.concatenate((ids[active], new), 1)
            all_done = np.concatenate((done[active], ~fresh), 1)
            keep = np.argpartition(all_far, beam - 1, axis=1)[:, :beam]
            far[active], ids[active] = np.take_along_axis(all_far, keep, 1), np.take_along_axis(all_ids, keep, 1)
            done[active] = np.take_along_axis(all_done, keep, 1)
        active = active[(~done[active] & np.isfinite(far[active])).any(1)]
    order = np.argsort(far, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1), rows


def robust_prune(x: np.ndarray, nodes: np.ndarray, pool: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """Diverse edges for each node out of its pool (-1: none): the nearest is kept again and again,
    and what is more than `relax` times nearer to it than to the node goes."""
    pool = np.where(pool == nodes[:, None], -1, pool)
    pool = -np.sort(-pool, axis=1)
    pool[:, 1:][pool[:, 1:] == pool[:, :-1]] = -1
    ends = x[np.maximum(pool, 0)]
    own = ((ends - x[nodes][:, None, :]) ** 2).sum(2)
    own[pool < 0] = np.inf
    norm = (ends * ends).sum(2)
    apart = norm[:, :, None] + norm[:, None, :] - 2 * ends @ ends.transpose(0, 2, 1)
    out = np.full((len(nodes), degree), -1, np.int64)
    rows, left = np.arange(len(nodes)), own.copy()
    for k in range(degree):
        best = left.argmin(1)
        some = np.isfinite(left[rows, best])
        if not some.any():
            break
        out[some, k] = pool[rows, best][some]
        left[(relax**2) * apart[rows, best] <= own] = np.inf
        left[rows, best] = np.inf
    return out


def _offer(x: np.ndarray, edges: np.ndarray, ends: np.ndarray, starts: np.ndarray, degree: int, relax: float) -> None:
    """Edges from ends back to starts. Where a node has no room for its new ones, old and new are pruned."""
    order = np.argsort(ends, kind="stable")
    ends, starts = ends[order], starts[order]
    new = ~(edges[ends] == starts[:, None]).any(1)
    ends, starts = ends[new], starts[new]
    at, where, count = np.unique(ends, return_index=True, return_counts=True)
    edges[at] = -np.sort(-edges[at], axis=1)  # so that free places are last
    have = (edges[at] >= 0).sum(1)
    fits = have + count <= edges.shape[1]
    own = np.repeat(fits, count)
    rank = np.arange(len(ends)) - np.repeat(where, count)
    edges[ends[own], (np.repeat(have, count) + rank)[own]] = starts[own]
    at, where, count = at[~fits], where[~fits], count[~fits]
    for t in range(0, len(at), GROUP):
        full, w, c = at[t : t + GROUP], where[t : t + GROUP], count[t : t + GROUP]
        back = np.full((len(full), int(c.max())), -1, np.int64)
        r = np.repeat(np.arange(len(full)), c)
        col = np.arange(len(r)) - np.repeat(np.cumsum(c) - c, c)
        back[r, col] = starts[np.repeat(w, c) + col]
        edges[full, :degree] = robust_prune(x, full, np.concatenate((edges[full], back), 1), degree, relax)
        edges[full, degree:] = -1


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relax: float = RELAX, seed: int = 5) -> tuple:
    """(edges, entry nodes) over the rows of x, which are distinct."""
    n = len(x)
    rng = np.random.default_rng(seed)
    norm = (x * x).sum(1)
    edges = np.full((n, max(degree, ROOM)), -1, np.int64)
    first = min(degree // 2, n - 1)
    if first:
        edges[:, :first] = (np.arange(n)[:, None] + rng.integers(1, n, (n, first))) % n
    middle = int((norm - 2 * x @ x.mean(0)).argmin())
    entry = np.unique(np.append(rng.integers(0, n, 7), middle))
    for step in (1.0, relax):
        order = rng.permutation(n)
        for s in range(0, n, GROUP):
            nodes = order[s : s + GROUP]
            found, _, _ = beam_search(x, norm, edges, entry, x[nodes], min(beam, n))
            edges[nodes, :degree] = robust_prune(x, nodes, np.concatenate((found, edges[nodes]), 1), degree, step)
            edges[nodes, degree:] = -1
            ends, starts = edges[nodes, :degree].ravel(), np.repeat(nodes, degree)
            ends, starts = ends[ends >= 0], starts[ends >= 0]
            _offer(x, edges, ends, starts, degree, step)
    for s in range(0, n, GROUP):
        nodes = np.arange(s, min(n, s + GROUP))
        nodes = nodes[(edges[nodes] >= 0).sum(1) > degree]
        edges[nodes, :degree] = robust_prune(x, nodes, edges[nodes], degree, relax)
        edges[nodes, degree:] = -1
    edges = -np.sort(-edges, axis=1)[:, :degree]
    return edges, entry


class Shard:
    """Distinct vectors with their graph, built once and then searched in blocks of queries."""

    def __init__(self, x: np.ndarray, k: int, beam: int = BEAM):
        self.x, self.scale = x, np.abs(x).max()
        self.small = (x / self.scale).astype(np.float32)
        self.norm = (self.small * self.small).sum(1)
        self.beam = min(len(x), max(beam, k))
        self.keep = min(self.beam, k + 4)
        self.graph = build_graph(self.small) if len(x) > self.beam else None

    def search(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(node ids, exact distances) of about k nearest nodes for each row of q; -1 where none."""
        asked = (q / self.scale).astype(np.float32)
        if self.graph:
            out = beam_search(self.small, self.norm, *self.graph, asked, self.beam)[0][:, : self.keep]
        else:
            out = np.argsort(self.norm[None, :] - 2 * asked @ self.small.T, axis=1, kind="stable")[:, : self.keep]
        far = np.sqrt(np.cumsum((self.x[out] - q[:, None, :]) ** 2, axis=2)[:, :, -1])  # in order, as SQL sums
        far[out < 0] = np.inf
        return out, far


def _build(dim: int, k: int, beam: int):
    def build(members: pa.Table) -> tuple[Shard, list]:
        ids = members.column("ids").to_pylist()
        order = np.argsort([i[0] for i in ids], kind="stable")  # so that a graph doesn't depend on the order of arrival
        return Shard(matrix(members.column("vec").combine_chunks(), dim)[order], k + 1, beam), [ids[i] for i in order]

    return build


def _ask(dim: int, k: int):
    def ask(state: tuple[Shard, list], batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        shard, ids = state
        queries, q = arrow_rows(batch, "id").to_numpy(), matrix(arrow_rows(batch, "vec"), dim)
        for s in range(0, len(q), GROUP):
            out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
            found, far = shard.search(q[s : s + GROUP])
            for query, nodes, scores in zip(queries[s : s + GROUP].tolist(), found.tolist(), far.tolist(), strict=True):
                own = sorted((d, i) for n, d in zip(nodes, scores, strict=True) if n >= 0 for i in ids[n] if i != query)[:k]
                out["query_id"] += [query] * len(own)
                out["vec_id"] += [i for _, i in own]
                out["score"] += [d for d, _ in own]
            kinds = (pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    return ask


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
    beam: int = BEAM, shard: int = SHARD,
) -> DataFrame:
    """(query_id, rank, id_col, score): the k nearest of vectors found for each of queries, but itself.

    Nearest is the smallest Euclidean distance; ties go to the smaller id. Both inputs have
    id_col and vec_col. Null, empty or zero vectors, those with null or non-finite components
    and rows with a null id take no part on either side. Vectors of another length than a
    query's are no candidates. With fewer than k candidates all come back. Rows that repeat both
    id and vector are one on either side; an id with several vectors stands there with each.
    """
    named = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    good = lambda df: named(df).filter(F.col("id").isNotNull() & takes_part(F.col("vec"))).distinct()
    few = good(vectors).withColumn("r", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).filter(F.col("r") <= k + 2)
    nodes = cut(few.groupBy("vec").agg(F.sort_array(F.collect_set("id")).alias("ids")).withColumn("dim", F.size("vec")))
    sizes = {r[0]: r[1] for r in nodes.groupBy("dim").count().collect()}  # a row for each length of vector
    if not sizes:
        return vectors.sparkSession.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    found = None
    for dim, n in sorted(sizes.items()):
        count = -(-n // shard)
        dealt = nodes.filter(F.col("dim") == dim).select(F.pmod(F.xxhash64("vec"), F.lit(count)).cast("int").alias("tile"), "ids", "vec")
        asked = good(queries).filter(F.size("vec") == dim).select(F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("tile"), "id", "vec")
        own = stream_tiles(dealt, asked, count, _build(dim, k, beam), _ask(dim, k), "query_id long, vec_id long, score double")
        found = own if found is None else found.unionByName(own)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return (
        found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), F.col("vec_id").alias(id_col), "score")
    )


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest of all embeddings for each whose id is divisible by 100."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.filter(F.col("vec_id") % 100 == 0))


#: Exact search. The graph finds the same rows where a shard's neighbours are all found, as on small tables.
ORACLE = """
WITH good AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         sqrt(list_reduce(list_transform(list_zip(q.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda s, x: s + x)) AS score
  FROM good q JOIN good c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank::int AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""
