"""A seam for models: rows that a cache lacks are asked in batches, by a model that each worker loads once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwork.operators.tables import to_do

#: Rows asked of a model at once.
BATCH = 32


def embed_missing(items: DataFrame, cache: DataFrame, make_model: Callable, batch: int = BATCH) -> DataFrame:
    """(key, embedding, error) for items (key, pixels) that cache (key, embedding, error) doesn't answer.

    make_model takes nothing and gives a function from an array of up to `batch` rows of pixels to an array of as many
    embeddings; it is called once in each worker. All pixels have one length. A key of the cache that has an embedding or an
    error isn't asked again; items without pixels, or with nulls among them, aren't asked and get the error 'unreadable'. A key that items hold twice
    is asked once. Merge the result into the cache (sources.store.KeyedTable) to keep it.
    """
    todo = to_do(items.select("key", "pixels"), cache, "key", "embedding", "error")
    todo = todo.groupBy("key").agg(F.first("pixels", ignorenulls=True).alias("pixels"))  # one row a key
    whole = F.coalesce((F.size("pixels") > 0) & ~F.exists("pixels", lambda x: x.isNull()), F.lit(False))
    size = items.filter(whole).select(F.size("pixels")).first()
    none = todo.filter(~whole).select("key", F.lit(None).cast("array<float>").alias("embedding"), F.lit("unreadable").alias("error"))
    if size is None:
        return none
    ask = predict_batch_udf(make_model, return_type=T.ArrayType(T.FloatType()), batch_size=batch, input_tensor_shapes=[[size[0]]])
    return todo.filter(whole).select("key", ask("pixels").alias("embedding"), F.lit(None).cast("string").alias("error")).unionByName(none)
