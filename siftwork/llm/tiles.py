"""Blocks of members that stay in memory while any number of queries streams past them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm.words import arrow_rows

#: Partitions at most; beyond it a partition has several tiles, one after the other.
PARTITIONS = 20_000


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    for batch in batches:
        tile, side = (arrow_rows(batch, c).to_numpy(zero_copy_only=False) for c in ("tile", "side"))
        edges = np.flatnonzero((tile[1:] != tile[:-1]) | (side[1:] != side[:-1])) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(batch)], strict=True):
            if b > a:
                yield int(tile[a]), int(side[a]), batch.slice(a, b - a)


def stream_tiles(
    members: DataFrame, queries: DataFrame, tiles: int, build: Callable[[pa.Table], object],
    ask: Callable[[object, pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str,
) -> DataFrame:
    """What ask gives for every batch of queries of a tile, given what build made once of the tile's members.

    Both inputs have a column tile (0..tiles-1); their other columns are told apart by name. A tile's members
    must fit in memory; its queries come in Arrow batches, sorted behind the members. Tiles without
    members or without queries give nothing.
    """
    parts = max(1, min(tiles, PARTITIONS))
    both = members.withColumn("side", F.lit(0)).unionByName(queries.withColumn("side", F.lit(1)), allowMissingColumns=True)
    dealt = both.repartitionById(parts, F.pmod("tile", F.lit(parts))).sortWithinPartitions("tile", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held, state = None, [], None
        for at, side, part in _runs(batches):
            if at != tile:
                tile, held, state = at, [], None
            if side == 0:
                held.append(part)
                continue
            if held:
                state, held = build(pa.Table.from_batches(held)), []
            if state is not None:
                yield from ask(state, part)

    return dealt.mapInArrow(run, schema)
