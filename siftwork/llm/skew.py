"""Joins that deal the rows of hot keys over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with so many rows is hot; so many hot keys at most are told to the side with the rows.
HOT_ROWS, HOT_KEYS = 2_000, 16_384


def dealt_join(rows: DataFrame, facts: DataFrame, keys: list[str], n_col: str, counts: DataFrame | None = None) -> DataFrame:
    """rows joined with facts, which has one row a key and in n_col how many of rows have that key.

    counts: (keys, n_col) of the same keys or more, where those of facts are dear to compute twice.

    Rows of the HOT_KEYS hottest keys at most, a table of fixed bound that is broadcast, are dealt over
    salts by their other columns, and the facts of hot keys are repeated for each salt. There are at
    most rows / HOT_ROWS hot keys, so the copies stay below a tenth of the rows. No row is left out.
    """
    salts = max(1, min(HOT_ROWS // 10, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    hot = (
        (facts if counts is None else counts).filter(F.col(n_col) >= HOT_ROWS)
        .select(n_col, *keys)
        .orderBy(F.desc(n_col), *keys)
        .limit(HOT_KEYS)
        .select(*keys, F.lit(True).alias("__hot"))
    )
    others = [F.col(c) for c in rows.columns if c not in keys]
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn(
        "__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(*others), F.lit(salts)).cast("int")).otherwise(0)
    )
    copies = facts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.when(F.col(n_col) >= HOT_ROWS, salts - 1).otherwise(0))))
    return dealt.drop("__hot").join(copies, [*keys, "__salt"]).drop("__salt")
