"""Near-duplicate joins: Hamming by chunks, bands of a number, and the best match."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwork.functions import scalars as S
from siftwork.operators.skew import dealt_join
from siftwork.session import stored


#: Chunks a 64-bit value is cut into, and the bits that may differ in one: a pair within 4 * (FLIPS + 1) - 1 bits has
#: a chunk of 16 bits that differs in FLIPS at most.
CHUNKS, FLIPS = 4, 2
#: Rows of one chunk that meet in one task; a chunk of more is dealt over blocks of so many.
BLOCK = 2_000


def hamming_join(left: DataFrame, right: DataFrame, a: str, b: str, distance: int, on: Column | None = None) -> DataFrame:
    """Pairs whose 64-bit values differ in at most `distance` bits, with that number as `distance`.

    The value is cut into four chunks of 16 bits. In one of them a pair differs in distance // 4 bits at most, so
    the left side looks for each chunk with each choice of so many bits flipped: an equi-join on (chunk
    number, chunk) of 16 bits. That is 4 rows of the left for a distance up to 3, 68 up to 7 and 548 up to
    11. Farther ones are refused: they would meet by chance. The smaller side belongs on the left.
    A pair comes from its first chunk that is near enough, so nothing is made distinct. The right side's rows of a chunk of more
    than BLOCK are dealt over blocks, and the left side's are repeated for each; there are 262,144 chunks at most, of which the hot ones are told to both sides.
    Equal values all meet: where many are equal, join classes of them (`picture_classes`).
    Both sides are shuffled, whatever Spark takes their size to be: its estimate knows nothing of the rows that chunks and masks add, and a side
    that it takes for small would go whole through the driver. All columns are repeated with each of those rows; wide ones are better joined to the pairs.
    on: a further condition, checked inside the join.
    """
    flips = distance // CHUNKS
    if flips > FLIPS:
        raise ValueError(f"a distance of {distance} bits is beyond what chunks of 16 bits select")
    width = 64 // CHUNKS
    masks = [sum(1 << i for i in c) for k in range(flips + 1) for c in itertools.combinations(range(width), k)]
    chunk = lambda c, i: S.chunk(F.col(c), i, CHUNKS)
    cut = lambda df, c, name: df.select("*", F.posexplode(F.array(*[chunk(c, i) for i in range(CHUNKS)])).alias(f"{name}_i", f"{name}_v"))
    y = cut(right, b, "__b")
    x = cut(left, a, "__a").withColumn("__m", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])))
    x = x.withColumn("__v", F.col("__a_v").bitwiseXOR(F.col("__m"))).drop("__a_v", "__m")
    hot = y.groupBy(F.col("__b_i").alias("__hi"), F.col("__b_v").alias("__hv")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("__blocks")).filter("__blocks > 1")
    blocks = F.coalesce("__blocks", F.lit(1))
    y = y.join(F.broadcast(hot), (F.col("__b_i") == F.col("__hi")) & (F.col("__b_v") == F.col("__hv")), "left")
    y = y.withColumn("__b_k", F.pmod(F.xxhash64(*right.columns), blocks).cast("int")).drop("__hi", "__hv", "__blocks")
    x = x.join(F.broadcast(hot), (F.col("__a_i") == F.col("__hi")) & (F.col("__v") == F.col("__hv")), "left")
    x = x.withColumn("__a_k", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("__hi", "__hv", "__blocks")
    both = x.join(y.hint("merge"), (F.col("__a_i") == F.col("__b_i")) & (F.col("__v") == F.col("__b_v")) & (F.col("__a_k") == F.col("__b_k")))
    near = S.hamming(F.col(a), F.col(b))
    fits = near <= distance if on is None else (near <= distance) & on
    for i in range(CHUNKS - 1):
        fits = fits & ((F.col("__a_i") <= i) | (F.bit_count(chunk(a, i).bitwiseXOR(chunk(b, i))) > flips))
    return both.filter(fits).withColumn("distance", near).drop("__a_i", "__b_i", "__b_v", "__a_k", "__b_k", "__v")


def picture_classes(pictures: DataFrame) -> DataFrame:
    """(id, class_id, n, any_new) of pictures (id, hashes, greys, is_new): pictures of equal hashes and greys are one class, named by its least id.

    A picture whose hashes or greys are null is a class of its own. Rows move as 128 hash bits; a class of any size is folded in each task first.
    """
    whole = F.col("hashes").isNotNull() & F.col("greys").isNotNull()
    own = F.when(whole, F.lit(None).cast("string")).otherwise(F.col("id").cast("string"))
    rows = pictures.select("id", "is_new", F.xxhash64("hashes", "greys", own).alias("h1"), F.xxhash64(F.lit(7), "greys", own, "hashes").alias("h2"))
    classes = rows.groupBy("h1", "h2").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_or("is_new"), F.lit(False)).alias("any_new"))
    return dealt_join(rows.select("id", "h1", "h2"), classes, ["h1", "h2"], "n").select("id", "class_id", "n", "any_new")


def similar_classes(pictures: DataFrame, distance: int = 3, residual: float = 6.0) -> tuple[DataFrame, DataFrame]:
    """(membership, pairs): picture_classes, and similar_pictures of one picture a class. At least one picture of two classes is new.

    Pictures of a class are alike at no distance, and are not given as pairs; every pair of different pictures that are alike is one of
    its classes' pair.
    """
    members = stored(picture_classes(pictures))
    first = members.filter("id = class_id").select("id", F.col("any_new").alias("is_new"))
    return members, similar_pictures(stored(pictures.drop("is_new").join(first.hint("merge"), "id")), distance, residual)


def similar_pictures(pictures: DataFrame, distance: int = 3, residual: float = 6.0) -> DataFrame:
    """(a, b, rotation, distance, diff) of pictures that look alike, a < b, with a turned by rotation * 90 degrees.

    pictures: id, hashes and greys (each an array of four, one a rotation; a grey is a flat array), is_new. At least
    one of a pair is new. The first rotation within `distance` bits and a mean difference of `residual` counts.
    Hashes alone meet by chunks; greys are joined to the pairs that are near.
    """
    turned = pictures.select(F.col("id").alias("a"), F.col("is_new").alias("new_a"), F.posexplode("hashes").alias("rotation", "ha"))
    plain = pictures.select(F.col("id").alias("b"), F.col("is_new").alias("new_b"), F.get("hashes", F.lit(0)).alias("hb"))
    near = hamming_join(turned, plain, "ha", "hb", distance, (F.col("a") < F.col("b")) & (F.col("new_a") | F.col("new_b"))).select("a", "b", "rotation", "distance")
    near = near.join(pictures.select(F.col("id").alias("a"), F.col("greys").alias("greys_a")).hint("merge"), "a").withColumn("grey_a", F.get("greys_a", F.col("rotation"))).drop("greys_a")
    near = near.join(pictures.select(F.col("id").alias("b"), F.get("greys", F.lit(0)).alias("grey_b")).hint("merge"), "b")
    near = near.withColumn("diff", S.mean_difference(F.col("grey_a"), F.col("grey_b"))).filter(F.col("diff") <= residual)
    return near.groupBy("a", "b").agg(F.min(F.struct("rotation", "distance", "diff")).alias("m")).select("a", "b", "m.*")


def messenger_matches(copies: DataFrame, originals: DataFrame, distance: int = 6, aspect: float = 0.03, cosine: float | None = None) -> DataFrame:
    """(copy, original, distance): the original that looks most like each copy, the larger of equals, then the smaller id.

    Both sides have id, hash, width, height and, where `cosine` is given, embedding of length 1; id names one row. The shapes differ by
    `aspect` of the copy's at most. Embeddings are joined to the pairs whose hashes and shapes fit, not repeated with each chunk.
    """
    side = lambda df, x, *more: df.select(F.col("id").alias(x), F.col("hash").alias(f"h_{x}"), (F.col("width") / F.greatest("height", F.lit(1))).alias(f"r_{x}"), *more)
    area = (F.col("width") * F.col("height")).alias("area_original")
    fits = F.abs(F.col("r_original") - F.col("r_copy")) <= aspect * F.col("r_copy")
    near = hamming_join(side(copies, "copy"), side(originals, "original", area), "h_copy", "h_original", distance, fits).select("copy", "original", "area_original", "distance")
    if cosine is not None:
        for df, x in ((copies, "copy"), (originals, "original")):
            near = near.join(df.select(F.col("id").alias(x), F.col("embedding").alias(f"e_{x}")).hint("merge"), x)
        near = near.filter(S.dot(F.col("e_copy"), F.col("e_original")) >= cosine)
    best = near.groupBy("copy").agg(F.min(F.struct("distance", (-F.col("area_original")).alias("low"), "original")).alias("m"))
    return best.select("copy", F.col("m.original").alias("original"), F.col("m.distance").alias("distance"))


def video_copies(new: DataFrame, every: DataFrame, distance: int = 8, seconds: float = 0.5) -> DataFrame:
    """(id, copy_of): the better copy of each new video that is as long to `seconds` and alike in all three frames.

    Both have id, duration, frames (hashes), in_library, size. Library first, then the larger, then the smaller
    id; a copy that is neither in the library nor larger is no better one. Clips meet by duration and a piece of the first frame
    together, 27 rows a new clip at 8 bits. Both sides are shuffled, as in hamming_join.
    """
    pieces = distance + 1  # hashes that differ in `distance` bits agree in one of so many pieces
    width = 64 // pieces
    piece = lambda i: F.shiftrightunsigned(F.get("frames", F.lit(0)), i * width).bitwiseAND((1 << (width if i < pieces - 1 else 64 - i * width)) - 1)
    side = lambda df, x: df.filter(F.size("frames") == 3).select(
        F.col("id").alias(x), F.col("duration").alias(f"d_{x}"), F.col("frames").alias(f"f_{x}"), F.col("in_library").alias(f"l_{x}"), F.col("size").alias(f"s_{x}"),
        F.floor(F.col("duration") / seconds).alias("band"), F.posexplode(F.array(*[piece(i) for i in range(pieces)])).alias("i", "piece"),
    )
    near = F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)]))
    both = side(new.filter("duration > 0"), "n").withColumn("band", near).join(side(every, "m").hint("merge"), ["band", "i", "piece"])
    on = (F.col("n") != F.col("m")) & (F.abs(F.col("d_n") - F.col("d_m")) <= seconds) & (F.col("l_m") | (F.col("s_m") > F.col("s_n")))
    for i in range(3):
        on = on & (S.hamming(F.col("f_n")[i], F.col("f_m")[i]) <= distance)
    best = both.filter(on).groupBy("n").agg(F.min(F.struct((~F.col("l_m")).alias("outside"), (-F.col("s_m")).alias("low"), "m")).alias("b"))
    return best.select(F.col("n").alias("id"), F.col("b.m").alias("copy_of"))


def band_join(left: DataFrame, right: DataFrame, a: str, b: str, width: float, on: Column | None = None) -> DataFrame:
    """Pairs with abs(a - b) <= width, by buckets of that width and their neighbours: an equi-join."""
    x = left.withColumn("__bucket", F.floor(F.col(a) / width))
    y = right.withColumn("__bucket", F.explode(F.array(*[F.floor(F.col(b) / width) + i for i in (-1, 0, 1)])))
    near = F.abs(F.col(a) - F.col(b)) <= width
    return x.join(y, "__bucket").filter(near if on is None else near & on).drop("__bucket")


def best_match(pairs: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first pair of each key; Spark limits each task to one row a key before the shuffle."""
    return pairs.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__r = 1").drop("__r")


def pair_kind(worst: Column, a_dims: Column, b_dims: Column, rotation: Column) -> Column:
    """'copy' of the same picture, or a 'shot' of the same moment. dims: arrays of width and height."""
    resized = F.array_sort(a_dims) != F.array_sort(b_dims)
    return F.when((worst <= 4) | ((resized | (rotation != 0)) & (worst <= 10)), "copy").otherwise("shot")


def pair_keep(kind: Column, a_pixels: Column, b_pixels: Column, a_size: Column, b_size: Column, a_album: Column, b_album: Column) -> Column:
    """Which side to keep: more pixels, then bytes; at about equal size the one in an album; both for shots."""
    ratio = S.size_ratio(a_pixels, b_pixels)
    more = F.when((b_pixels > a_pixels) | ((b_pixels == a_pixels) & (b_size > a_size)), "B").otherwise("A")
    album = (kind == "copy") & (a_album != b_album) & ratio.between(0.95, 1.05)
    return F.when(album, F.when(a_album, "A").otherwise("B")).when(kind == "copy", more).otherwise("both")


def mean_vector(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, mean): component means, scaled to length 1."""
    each = rows.select(key, F.posexplode(vector).alias("i", "v")).groupBy(key, "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    mean = each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("m"))
    norm = F.sqrt(S.dot(F.col("m"), F.col("m")))
    return mean.select(key, F.transform("m", lambda x: x / F.when(norm == 0, 1.0).otherwise(norm)).alias("mean"))
