"""Queries over fingerprints, embeddings, classification, dates and destinations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.functions import inference
from siftwork.functions import scalars as S
from siftwork.operators import decisions as D
from siftwork.operators import planner, similar, zones
from siftwork.plans.register import query
from siftwork.session import cut, stored, table

BITS = """bits AS (
  SELECT vec_id, label, embedding, array_to_string(list_transform(embedding, lambda v: CASE WHEN v > list_sort(embedding[2:])[(len(embedding)) // 2] THEN '1' ELSE '0' END), '') AS bits
  FROM embeddings)"""
#: Pictures out of parts: three of a kind share a hash and a grey up to few bits and small differences; the third is turned.
PICTURES = """h AS (SELECT p_partkey AS id, p_partkey // 3 AS kind, p_partkey % 3 AS m, p_size AS s, p_partkey % 7 < 4 AS is_new, unnest([0, 1, 2, 3]) AS r FROM part),
  x AS (SELECT *, CASE WHEN m = 2 THEN (r + kind) % 4 ELSE r END AS q FROM h),
  y AS (SELECT *, sha256(concat(kind, '-', q)) AS d, CASE m WHEN 0 THEN 0 WHEN 1 THEN 1 << (kind % 31)::int ELSE (1 << (kind % 13)::int) + (1 << (13 + kind % 9)::int) + CASE WHEN kind % 5 < 3 THEN 0 ELSE (7 << 24) END END AS noise FROM x),
  z AS (SELECT id, m, s, is_new, kind, r, ('0x' || substr(d, 1, 8))::BIGINT AS hi, xor(('0x' || substr(d, 9, 8))::BIGINT, noise::BIGINT) AS lo,
    list_transform([0, 1, 2, 3], lambda i: (('0x' || substr(d, 17 + 2 * i::int, 2))::INT + m * (kind % 8))::DOUBLE) AS grey FROM y)"""
PAIRS = f"""WITH {PICTURES}, near AS (SELECT a.id AS a, b.id AS b, a.r AS rotation, (bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)))::int AS distance,
    (abs(a.grey[1] - b.grey[1]) + abs(a.grey[2] - b.grey[2]) + abs(a.grey[3] - b.grey[3]) + abs(a.grey[4] - b.grey[4])) / 4 AS diff
    FROM z a JOIN z b ON a.id < b.id AND b.r = 0 AND (a.is_new OR b.is_new) AND bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 3),
  pairs AS (SELECT a, b, arg_min(rotation, rotation)::int AS rotation, arg_min(distance, rotation) AS distance, arg_min(diff, rotation) AS diff FROM near WHERE diff <= 6 GROUP BY a, b)"""


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, kind, m, s, is_new, hashes and greys of four rotations."""
    i = F.col("p_partkey")
    kind, m = F.floor(i / 3), i % 3
    rows = table(spark, sf_dir, "part").select(i.alias("id"), kind.alias("kind"), m.alias("m"), F.col("p_size").alias("s"), (i % 7 < 4).alias("is_new"))
    bit = lambda n: F.expr(f"shiftleft(1L, cast({n} as int))")
    noise = F.when(F.col("m") == 0, F.lit(0).cast("long")).when(F.col("m") == 1, bit("kind % 31")).otherwise(
        bit("kind % 13") + bit("13 + kind % 9") + F.when(F.col("kind") % 5 < 3, 0).otherwise(7 << 24)
    )
    digest = lambda r: F.sha2(F.concat(F.col("kind").cast("string"), F.lit("-"), F.when(F.col("m") == 2, (F.col("kind") + r) % 4).otherwise(r).cast("string")), 256)
    hex_ = lambda d, at, n: F.conv(F.substring(d, at, n), 16, 10).cast("long")
    hashes = [F.shiftleft(hex_(digest(r), 1, 8), 32).bitwiseOR(hex_(digest(r), 9, 8).bitwiseXOR(noise)) for r in range(4)]
    greys = [F.array(*[(hex_(digest(r), 17 + 2 * k, 2) + F.col("m") * (F.col("kind") % 8)).cast("double") for k in range(4)]) for r in range(4)]
    return stored(rows.withColumns({"hashes": F.array(*hashes), "greys": F.array(*greys)}))


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.select("vec_id", "label", "embedding", S.pack_by_median(F.col("embedding")).alias("hash"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.similar_pictures(pictures(spark, sf_dir))


@query(f"WITH {BITS} SELECT vec_id, bits, substr(bits, 49, 16) AS chunk0 FROM bits")
def phash_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = lambda c, n: F.lpad(F.bin(c), n, "0")
    own = fingerprints(spark, sf_dir)
    return own.select("vec_id", wide(F.col("hash"), 64).alias("bits"), wide(S.chunk(F.col("hash"), 0, 4), 16).alias("chunk0"))


@query(f"{PAIRS} SELECT a, b, rotation, distance, diff FROM pairs")
def hamming_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures alike within 3 bits at any of four rotations and a mean difference of 6, one of them new."""
    return pairs(spark, sf_dir)


@query(
    f"""WITH {PICTURES}, v AS (SELECT id, m, hi, lo, s + 20 AS width, 40 + kind % 3 AS height, cos(m * (kind % 6) * 0.1) AS ex, sin(m * (kind % 6) * 0.1) AS ey FROM z WHERE r = 0),
    near AS (SELECT c.id AS copy, o.id AS original, (bit_count(xor(c.hi, o.hi)) + bit_count(xor(c.lo, o.lo)))::int AS distance, o.width * o.height AS area FROM v c JOIN v o
      ON c.m = 1 AND o.m <> 1 AND bit_count(xor(c.hi, o.hi)) + bit_count(xor(c.lo, o.lo)) <= 6 AND abs(o.width / o.height - c.width / c.height) <= 0.2 * (c.width / c.height)
      AND c.ex * o.ex + c.ey * o.ey >= 0.92)
    SELECT copy, original, distance FROM (SELECT *, row_number() OVER (PARTITION BY copy ORDER BY distance, area DESC, original) AS r FROM near) WHERE r = 1"""
)
def hamming_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest original of each copy within 6 bits, of about its shape and a cosine of 0.92.

    Parts of a kind differ in size at random, so shapes may differ by a fifth here; the operator's own 3 % leave few rows.
    """
    angle = F.col("m") * (F.col("kind") % 6) * 0.1
    own = pictures(spark, sf_dir).select(
        "id", "m", F.get("hashes", F.lit(0)).alias("hash"), (F.col("s") + 20).alias("width"), (F.col("kind") % 3 + 40).alias("height"), F.array(F.cos(angle), F.sin(angle)).alias("embedding")
    )
    return similar.messenger_matches(own.filter("m = 1"), own.filter("m <> 1"), aspect=0.2, cosine=0.92)


@query(
    f"""WITH {PICTURES}, f AS (SELECT id, list(hi ORDER BY r) FILTER (r < 3) AS hi, list(lo ORDER BY r) FILTER (r < 3) AS lo, max(kind % 50 + m * 0.2) AS duration, bool_or(m = 2) AS lib, max(s) AS size, bool_or(m < 2) AS new FROM z WHERE m < 2 OR kind % 4 = 0 GROUP BY id),
    near AS (SELECT n.id, o.id AS other, o.lib, o.size FROM f n JOIN f o ON n.new AND n.duration > 0 AND n.id <> o.id AND abs(n.duration - o.duration) <= 0.5 AND (o.lib OR o.size > n.size)
      AND bit_count(xor(n.hi[1], o.hi[1])) + bit_count(xor(n.lo[1], o.lo[1])) <= 8 AND bit_count(xor(n.hi[2], o.hi[2])) + bit_count(xor(n.lo[2], o.lo[2])) <= 8
      AND bit_count(xor(n.hi[3], o.hi[3])) + bit_count(xor(n.lo[3], o.lo[3])) <= 8)
    SELECT id, other AS copy_of FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY lib DESC, size DESC, other) AS r FROM near) WHERE r = 1"""
)
def video_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The better copy of each new clip: as long to half a second, all three frames within 8 bits."""
    own = pictures(spark, sf_dir).filter("m < 2 OR kind % 4 = 0").select(
        "id", (F.col("kind") % 50 + F.col("m") * 0.2).alias("duration"), F.slice("hashes", 1, 3).alias("frames"), (F.col("m") == 2).alias("in_library"), F.col("s").alias("size")
    )
    return similar.video_copies(own.filter("NOT in_library"), own)


@query(f"{PAIRS} SELECT id, count(*) AS n_pairs FROM (SELECT a AS id FROM pairs UNION ALL SELECT b FROM pairs) GROUP BY id HAVING count(*) > 1")
def pair_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures that are in more than one pair."""
    return pairs(spark, sf_dir).select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n_pairs")).filter("n_pairs > 1")


@query(
    """WITH p AS (SELECT a.p_partkey AS a, b.p_partkey AS b, a.p_size AS aw, b.p_size AS bw, abs(a.p_retailprice - b.p_retailprice) AS worst,
      (a.p_partkey % 4)::int AS rotation, a.p_size * 100 AS pa, b.p_size * 100 AS pb, length(a.p_name) AS sa, length(b.p_name) AS sb,
      a.p_partkey % 5 = 0 AS aa, b.p_partkey % 5 = 0 AS ba FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
    k AS (SELECT *, CASE WHEN worst <= 4 OR ((aw <> bw OR rotation <> 0) AND worst <= 10) THEN 'copy' ELSE 'shot' END AS kind FROM p)
    SELECT a, b, kind, CASE WHEN kind = 'copy' AND aa <> ba AND pa / greatest(pb, 1) BETWEEN 0.95 AND 1.05 THEN CASE WHEN aa THEN 'A' ELSE 'B' END
      WHEN kind = 'copy' THEN CASE WHEN pb > pa OR (pb = pa AND sb > sa) THEN 'B' ELSE 'A' END ELSE 'both' END AS keep FROM k"""
)
def pair_kind_and_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    side = lambda x: part.select(
        F.col("p_partkey").alias(x), F.col("p_size").alias(f"w{x}"), F.col("p_retailprice").alias(f"v{x}"), (F.col("p_size") * 100).alias(f"p{x}"),
        F.length("p_name").alias(f"s{x}"), (F.col("p_partkey") % 5 == 0).alias(f"in{x}"),
    )
    both = side("a").withColumn("next", F.col("a") + 1).join(side("b"), F.col("next") == F.col("b"))
    c = F.col
    kind = similar.pair_kind(F.abs(c("va") - c("vb")), F.array(c("wa"), F.lit(100)), F.array(c("wb"), F.lit(100)), c("a") % 4)
    both = both.withColumn("kind", kind)
    return both.select("a", "b", "kind", similar.pair_keep(c("kind"), c("pa"), c("pb"), c("sa"), c("sb"), c("ina"), c("inb")).alias("keep"))


_BAND = """near AS (SELECT n.event_id AS clip, l.event_id AS match, l.event_id % 2 = 1 AS library, l.user_id AS size FROM events n JOIN events l
  ON n.event_type = l.event_type AND n.event_id % 10 = 0 AND l.event_id <> n.event_id AND l.event_id % 10 <> 0 AND abs(n.value - l.value) <= 0.005)"""


@query(f"WITH {_BAND} SELECT clip, match FROM (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY library DESC, size DESC, match) AS r FROM near) WHERE r = 1")
def band_join_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best copy of each new clip among those about as long: library first, then size.

    A hundredth of the reference's 0.5 s: event values lie so close that 0.5 joins 1,799,080 pairs for
    10,000 clips of sf0.1 and nearly every clip has copies by chance; 0.005 joins 17,904. What is
    0.005 to 0.5 apart is no match here. band_join itself takes any width, and is tested at 0.5.
    """
    e = table(spark, sf_dir, "events")
    new = e.filter("event_id % 10 = 0").select(F.col("event_id").alias("clip"), F.col("value").alias("d"), F.col("event_type").alias("t"))
    old = e.filter("event_id % 10 <> 0").select(
        F.col("event_id").alias("match"), F.col("value").alias("dd"), F.col("event_type").alias("tt"), (F.col("event_id") % 2 == 1).alias("library"), F.col("user_id").alias("size")
    )
    near = similar.band_join(new, old, "d", "dd", 0.005, F.col("t") == F.col("tt"))
    return similar.best_match(near, "clip", F.desc("library"), F.desc("size"), F.col("match")).select("clip", "match")


_MEANS = """mv AS (SELECT label, i, avg(v) AS v FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i),
  nm AS (SELECT label, sqrt(sum(v * v)) AS n FROM mv GROUP BY label)"""


@query(f"WITH {_MEANS} SELECT label, i - 1 AS i, round_even(v / n, 6) AS v FROM mv JOIN nm USING (label)")
def mean_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = similar.mean_vector(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return means.select("label", F.posexplode("mean").alias("i", "v")).select("label", "i", F.bround("v", 6).alias("v"))


@query(
    f"""WITH {_MEANS}, m AS (SELECT label AS prompt, list(v / n ORDER BY i) AS mean FROM mv JOIN nm USING (label) GROUP BY label),
    s AS (SELECT vec_id, prompt, list_dot_product(embedding::DOUBLE[], mean) AS c FROM embeddings, m)
    SELECT vec_id, prompt, round_even(c, 6) AS cosine, r AS place FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round_even(c, 9) DESC, prompt) AS r FROM s) WHERE r <= 3"""
)
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest label means of each vector. The means, a row a label, are one array that rides along with each row."""
    scored = _scores(spark, sf_dir)
    best = F.slice(F.array_sort(F.transform("scores", lambda s: F.struct((-F.bround(s["c"], 9)).alias("k"), s["prompt"], s["c"]))), 1, 3)
    out = scored.select("vec_id", F.posexplode(best).alias("i", "s"))
    return out.select("vec_id", F.col("s.prompt").alias("prompt"), F.bround("s.c", 6).alias("cosine"), (F.col("i") + 1).alias("place"))


#: Prompts at most that ride along with every row.
PROMPTS = 10_000


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id and its cosine with the mean of every label; labels are few and stand for prompts."""
    vectors = table(spark, sf_dir, "embeddings")
    means = cut(similar.mean_vector(vectors, "label", "embedding"))
    if means.count() > PROMPTS:
        raise ValueError(f"more than {PROMPTS} prompts don't ride along in one row")
    means = means.agg(F.array_sort(F.collect_list(F.struct(F.col("label").alias("prompt"), "mean"))).alias("prompts"))
    return vectors.crossJoin(F.broadcast(means)).select(  # one row of bounded size
        "vec_id", "label", F.transform("prompts", lambda p: F.struct(p["prompt"].alias("prompt"), S.dot(F.col("embedding"), p["mean"]).alias("c"))).alias("scores")
    )


@query(
    f"""WITH {_MEANS}, m AS (SELECT label AS prompt, list(v / n ORDER BY i) AS mean FROM mv JOIN nm USING (label) WHERE label < 7 GROUP BY label),
    s AS (SELECT vec_id, prompt, list_dot_product(embedding::DOUBLE[], mean) AS c FROM embeddings, m),
    e AS (SELECT vec_id, prompt, exp((c - max(c) OVER (PARTITION BY vec_id)) * 10) AS x FROM s),
    p AS (SELECT vec_id, prompt, x / sum(x) OVER (PARTITION BY vec_id) * CASE WHEN prompt = 1 AND vec_id % 3 = 0 THEN 2.0 WHEN prompt = 0 AND vec_id % 3 <> 0 THEN 1.5 ELSE 1 END AS q FROM e),
    z AS (SELECT vec_id, prompt, q / sum(q) OVER (PARTITION BY vec_id) AS q FROM p)
    SELECT vec_id, ['photo', 'screenshot', 'meme', 'advert', 'greeting', 'document', 'news'][prompt + 1] AS category, round_even(q, 6) AS confidence
    FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY q DESC, prompt) AS r FROM z) WHERE r = 1"""
)
def softmax_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class probabilities of each vector against seven prompts, nudged by file evidence."""
    few = F.filter("scores", lambda s: s["prompt"] < 7)
    soft = S.softmax(F.transform(few, lambda s: s["c"]), 10.0)
    names = F.transform(few, lambda s: F.element_at(F.array(*[F.lit(c) for c in S.CATEGORIES]), s["prompt"] + 1))
    rows = _scores(spark, sf_dir).select("vec_id", F.map_from_arrays(names, soft).alias("p"))
    phone = F.col("vec_id") % 3 == 0
    p = D.adjust_probabilities(F.col("p"), F.when(phone, 1080).otherwise(1000), F.when(phone, 2400).otherwise(1000), F.when(phone, "").otherwise("Acme"), F.lit("JPEG"))
    best = D.top_classes(p, 1)[0]
    return rows.select("vec_id", best.alias("b")).select("vec_id", F.col("b.name").alias("category"), F.bround("b.p", 6).alias("confidence"))


_FACTS = """facts AS (SELECT doc_id, ['photo', 'screenshot', 'meme', 'advert', 'greeting', 'document', 'news', 'unreadable'][(doc_id % 8 + 1)::int] AS category,
  (doc_id % 100) / 100.0::double AS confidence, (doc_id % 37) / 100.0::double AS photo, CASE WHEN toxic = 1 THEN 2 ELSE 0 END AS people,
  CASE WHEN doc_id % 11 = 0 THEN 'Acme One' ELSE '' END AS camera, doc_id % 13 = 0 AS gps, doc_id % 5 = 0 AS shape FROM documents LEFT JOIN labels USING (doc_id)),
  guarded AS (SELECT *, array_to_string(list_filter([CASE WHEN people > 0 THEN concat(people, ' tagged people') END, CASE WHEN camera <> '' THEN concat('camera data (', camera, ')') END,
  CASE WHEN gps THEN 'GPS location' END], lambda x: x IS NOT NULL), ', ') AS why FROM facts)"""


@query(
    f"""WITH {_FACTS} SELECT doc_id, category, CASE WHEN category = 'unreadable' THEN 'review' WHEN category NOT IN ('photo', 'document') THEN
      CASE WHEN why <> '' OR (shape AND category <> 'screenshot') OR photo > 0.15 THEN 'review' WHEN confidence >= 0.75 THEN 'reject' ELSE 'review' END
      WHEN category = 'document' THEN 'review' ELSE 'keep' END AS suggestion,
    CASE WHEN category = 'unreadable' THEN 'could not be opened' WHEN category NOT IN ('photo', 'document') THEN
      CASE WHEN why <> '' THEN concat('looks like ', category, ' but has ', why) WHEN shape AND category <> 'screenshot' THEN concat('looks like ', category, ' but has camera photo proportions')
      WHEN photo > 0.15 THEN concat('could also be a photo (', round_even(photo * 100, 0)::bigint, '%)') WHEN confidence >= 0.75 THEN '' ELSE 'low confidence' END
      WHEN category = 'document' THEN 'documents may be important' ELSE '' END AS note FROM guarded"""
)
def decide_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    c, i = F.col, F.col("doc_id")
    classes = F.array(*[F.lit(x) for x in (*S.CATEGORIES, "unreadable")])
    facts = docs.select(
        "doc_id", F.element_at(classes, (i % 8 + 1).cast("int")).alias("category"), ((i % 100) / F.lit(100.0)).alias("confidence"), ((i % 37) / F.lit(100.0)).alias("photo"),
        F.when(c("toxic") == 1, 2).otherwise(0).alias("people"), F.when(i % 11 == 0, "Acme One").otherwise("").alias("camera"), (i % 13 == 0).alias("gps"), (i % 5 == 0).alias("shape"),
    )
    made = D.decide(c("category"), c("confidence"), D.protection_reasons(c("people"), c("camera"), c("gps")), c("photo"), c("shape"))
    return facts.select("doc_id", "category", made.alias("d")).select("doc_id", "category", "d.suggestion", "d.note")


@query(
    """WITH d AS (SELECT p_partkey, [640, 720, 750, 828, 1080, 1242, 1000, 0][(p_partkey % 8 + 1)::int] AS w, [1334, 1440, 2400, 1920, 1125, 2208, 2000][(p_size % 7 + 1)::int] AS h FROM part),
    s AS (SELECT *, least(w, h) AS a, greatest(w, h) AS b FROM d)
    SELECT p_partkey, w, h, w > 0 AND h > 0 AND ((a = 640 AND b = 1136) OR (a = 750 AND b = 1334) OR (a = 1242 AND b = 2208)
      OR (a IN (640, 720, 750, 828, 1080, 1125, 1170, 1179, 1242, 1284, 1290, 1440, 1536, 1620, 1644, 1668) AND b / a >= 1.9)) AS screen,
    w > 0 AND h > 0 AND coalesce(abs(b / nullif(a, 0) - 4 / 3) <= 0.01 * (4 / 3) OR abs(b / nullif(a, 0) - 1.5) <= 0.015 OR abs(b / nullif(a, 0) - 16 / 9) <= 0.01 * (16 / 9), false) AS camera FROM s"""
)
def screen_and_camera_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda xs, at: F.element_at(F.array(*[F.lit(x) for x in xs]), at.cast("int"))
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", pick((640, 720, 750, 828, 1080, 1242, 1000, 0), F.col("p_partkey") % 8 + 1).alias("w"), pick((1334, 1440, 2400, 1920, 1125, 2208, 2000), F.col("p_size") % 7 + 1).alias("h")
    )
    return rows.select("*", S.screen_like(F.col("w"), F.col("h")).alias("screen"), S.camera_shaped(F.col("w"), F.col("h")).alias("camera"))


@query(
    "SELECT event_id, strftime(ts, '%Y-%m-%d') AS messenger, CASE WHEN event_id % 4 <> 0 THEN strftime(ts, '%Y:%m:%d %H:%M:%S') END AS camera, CASE WHEN event_id % 5 <> 0 THEN strftime(ts, '%Y:%m:%d %H:%M:%S') END AS exif FROM events"
)
def date_from_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates out of names and stored strings; odd ones give null."""
    i, show = F.col("event_id"), lambda c: F.date_format(c, "yyyy:MM:dd HH:mm:ss")
    e = table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("IMG-"), F.date_format("ts", "yyyyMMdd"), F.lit("-WA0001.jpg")).alias("wa"),
        F.concat(F.lit("PXL_"), F.when(i % 4 == 0, "20231399_256199").otherwise(F.date_format("ts", "yyyyMMdd_HHmmss")), F.lit(".jpg")).alias("cam"),
        F.when(i % 5 == 0, "0000:00:00 00:00:00").otherwise(F.date_format("ts", "yyyy:MM:dd HH:mm:ss")).alias("exif"),
    )
    return e.select("event_id", S.messenger_date(F.col("wa")).alias("messenger"), show(S.camera_name_date(F.col("cam"))).alias("camera"), show(S.exif_date(F.col("exif"))).alias("exif"))


_DATES = """f AS (SELECT o_orderkey, o_orderdate AS d, o_orderkey % 6 AS k, (o_custkey % 90)::int AS days FROM orders),
  c AS (SELECT *, CASE WHEN k = 1 THEN d + to_days(1) END AS exif, CASE WHEN k IN (2, 3) THEN d + to_days(days) + to_hours(8) END AS side,
    CASE WHEN k IN (3, 4) THEN date_trunc('day', d) + to_hours(12) END AS wa FROM f),
  picked AS (SELECT *, CASE WHEN exif IS NOT NULL THEN 'existing' WHEN side IS NOT NULL AND wa IS NOT NULL AND epoch(side) - epoch(wa) > 129600 THEN 'whatsapp-name' WHEN side IS NOT NULL THEN 'sidecar'
    WHEN wa IS NOT NULL THEN 'whatsapp-name' WHEN k = 5 THEN 'fallback (approximate)' ELSE 'none' END AS date_source FROM c),
  planned AS (SELECT o_orderkey, date_source, strftime(CASE date_source WHEN 'existing' THEN exif WHEN 'sidecar' THEN side WHEN 'whatsapp-name' THEN wa WHEN 'fallback (approximate)' THEN d END, '%Y:%m:%d %H:%M:%S') AS date_taken FROM picked)"""


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with several sources of a date, at a zone eight hours east, planned."""
    k, d, none = F.col("o_orderkey") % 6, F.col("o_orderdate"), F.lit(None).cast("string")
    files = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(k.isin(3, 4), F.concat(F.lit("IMG-"), F.date_format(d, "yyyyMMdd"), F.lit("-WA0001.jpg"))).otherwise("scan.jpg").alias("name"),
        F.lit("+08:00").alias("zone"), F.when(k == 1, F.date_format(F.date_add(d, 1), "yyyy:MM:dd HH:mm:ss")).alias("exif_date"), none.alias("xmp_date"),
        none.alias("create_date"), none.alias("creation_date"), none.alias("modify_date"),
        F.when(k.isin(2, 3), F.unix_timestamp(d) + (F.col("o_custkey") % 90) * 86400).alias("taken"), F.when(k == 5, F.date_format(d, "yyyy-MM-dd HH:mm:ss")).alias("fallback"),
    )
    return planner.choose_date(files, 2026)


@query(f"WITH {_DATES} SELECT o_orderkey, date_source, date_taken FROM planned")
def date_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dated(spark, sf_dir).select("o_orderkey", "date_source", "date_taken")


@query(
    f"WITH {_DATES} SELECT count(*) AS files, count(*) FILTER (date_source = 'existing') AS existing, count(*) FILTER (date_source = 'sidecar') AS sidecar, count(*) FILTER (date_source = 'whatsapp-name') AS from_name, "
    "count(*) FILTER (date_source LIKE 'fallback%') AS fallback, count(*) FILTER (date_source = 'none') AS undated, count(*) FILTER (date_source NOT IN ('existing', 'none')) AS to_write FROM planned"
)
def embed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("date_source")
    return dated(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("files"), F.count_if(s == "existing").alias("existing"), F.count_if(s == "sidecar").alias("sidecar"), F.count_if(s == "whatsapp-name").alias("from_name"),
        F.count_if(s.startswith("fallback")).alias("fallback"), F.count_if(s == "none").alias("undated"), F.count_if(~s.isin("existing", "none")).alias("to_write"),
    )


@query("SELECT c_custkey, CASE WHEN ok THEN la END AS lat, CASE WHEN ok THEN lo END AS lon FROM (SELECT *, abs(la) <= 90 AND abs(lo) <= 180 AND NOT (abs(la) < 1e-6 AND abs(lo) < 1e-6) AS ok FROM (SELECT c_custkey, c_acctbal / 50 AS la, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_acctbal / 30 END AS lo FROM customer))")
def gps_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    lon = F.when(F.col("c_custkey") % 9 == 0, "east").otherwise((F.col("c_acctbal") / 30).cast("string"))
    at = S.valid_gps((F.col("c_acctbal") / 50).cast("string"), lon)
    return c.select("c_custkey", at.alias("g")).select("c_custkey", "g.lat", "g.lon")


@query("SELECT conv_id, array_to_string(list(role ORDER BY first), ',') AS missing FROM (SELECT conv_id, role, min(turn) AS first FROM conversations WHERE turn > 0 GROUP BY conv_id, role) WHERE (conv_id, role) NOT IN (SELECT conv_id, role FROM conversations WHERE turn = 0) GROUP BY conv_id")
def tag_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of later turns that the first doesn't have, in order."""
    turns = table(spark, sf_dir, "conversations")
    ordered = lambda keep: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("turn", "role")))), lambda x: x["role"])
    own = turns.groupBy("conv_id").agg(ordered(F.col("turn") > 0).alias("wanted"), ordered(F.col("turn") == 0).alias("present"))
    return own.select("conv_id", F.array_join(planner.missing_values(F.col("wanted"), F.col("present")), ",").alias("missing")).filter("missing <> ''")


@query(
    f"""WITH {_DATES} SELECT o_orderkey, concat_ws(' | ', CASE WHEN date_source NOT IN ('existing', 'none') THEN concat('EXIF:DateTimeOriginal=', date_taken, ' | EXIF:OffsetTimeOriginal=+08:00') END,
      CASE WHEN o_orderkey % 5 = 0 THEN concat('XMP-dc:Description=', o_orderpriority, ' | EXIF:ImageDescription=', o_orderpriority) END,
      CASE WHEN o_orderkey % 7 = 0 THEN concat('XMP-iptcExt:PersonInImage+=', o_orderstatus) END) AS tags FROM planned JOIN orders USING (o_orderkey)"""
)
def tag_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, n = F.col("o_orderkey"), F.lit(None).cast("double")
    rows = dated(spark, sf_dir).join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus"), "o_orderkey")
    people = F.when(i % 7 == 0, F.array("o_orderstatus"))
    tags = planner.plan_tags(F.lit(".jpg"), F.col("date_source"), F.col("date_taken"), F.lit("+08:00"), F.lit(False), n, n, F.lit(False), F.when(i % 5 == 0, F.col("o_orderpriority")), people)
    return rows.select("o_orderkey", planner.tags_text(tags).alias("tags"))


@query(
    """SELECT dir, reason, count(*) AS n FROM (SELECT CASE WHEN k = 0 THEN 'Library/Albums/' || CASE WHEN trim(regexp_replace(p, '[<>:"/\\\\|?*]', '-', 'g'), ' .') = '' THEN 'Album' ELSE trim(regexp_replace(p, '[<>:"/\\\\|?*]', '-', 'g'), ' .') END
      WHEN k = 1 THEN 'Library/Undated' ELSE strftime(o_orderdate, 'Library/%Y/%Y-%m') END AS dir, CASE k WHEN 0 THEN 'album' WHEN 1 THEN 'undated' ELSE 'date' END AS reason
    FROM (SELECT *, o_orderkey % 4 AS k, concat(o_orderpriority, ' 2022/23.') AS p FROM orders)) GROUP BY ALL"""
)
def refile_destination(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    album = F.when(k == 0, F.concat("o_orderpriority", F.lit(" 2022/23.")))
    stamp = F.when(k != 1, F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss"))
    to = table(spark, sf_dir, "orders").select(D.refile_destination(album, stamp).alias("t")).select("t.dir", "t.reason")
    return to.groupBy("dir", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT page_id, CASE WHEN r = 1 THEN n ELSE concat(substr(n, 1, length(n) - 4), ' (', r, ').jpg') END AS dest, r > 1 AS renamed FROM (SELECT *, row_number() OVER (PARTITION BY d, n ORDER BY s) AS r FROM "
    "(SELECT page_id, regexp_extract(lower(url), '://([^/]*)', 1) AS d, concat('img', page_id % 7, '.jpg') AS n, lpad(page_id::varchar, 12, '0') AS s FROM pages))"
)
def refile_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(
        F.lpad(F.col("page_id").cast("string"), 12, "0").alias("source"), F.regexp_extract(F.lower("url"), "://([^/]*)", 1).alias("dir"),
        F.concat(F.lit("img"), (F.col("page_id") % 7).cast("string"), F.lit(".jpg")).alias("name"),
    )
    return planner.collision_free(pages).select(F.col("source").cast("long").alias("page_id"), "dest", "renamed")


#: Twelve directions, a point of an outline in each.
_AROUND = [(1.0, 0.0), (0.875, 0.5), (0.5, 0.875), (0.0, 1.0), (-0.5, 0.875), (-0.875, 0.5), (-1.0, 0.0), (-0.875, -0.5), (-0.5, -0.875), (0.0, -1.0), (0.5, -0.875), (0.875, -0.5)]


@query(
    "WITH d(k, dx, dy) AS (VALUES " + ", ".join(str((k, *d)) for k, d in enumerate(_AROUND)) + """),
    v AS (SELECT n_name AS zone, ring, k, (n_nationkey * 29 % 36) * 10.0::double - 175 + dx * r AS x, (n_nationkey * 17 % 13) * 10.0::double - 60 + dy * r AS y FROM (
      SELECT n_nationkey, n_name, ring, k, dx, dy, CASE WHEN ring = 1 THEN 2.0::double ELSE 4.0::double + (n_nationkey * 7 + k * 5) % 11 END AS r FROM nation, d, (VALUES (0), (1)) q(ring))),
    e AS (SELECT a.zone, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM v a JOIN v b ON a.zone = b.zone AND a.ring = b.ring AND b.k = (a.k + 1) % 12),
    z AS (SELECT zone, (max(x1) - min(x1)) * (max(y1) - min(y1)) AS area FROM e GROUP BY zone),
    p AS (SELECT doc_id, (doc_id * 37 % 1801) / 10.0::double - 90 AS lat, (doc_id * 7919 % 3601) / 10.0::double - 180 AS lon FROM documents),
    s AS (SELECT DISTINCT lat, lon, unnest([lon, lon + 360, lon - 360]) AS x FROM p),
    i AS (SELECT lat, lon, x, zone FROM s JOIN e ON (y1 <= lat) <> (y2 <= lat) AND x < x1 + (lat - y1) * (x2 - x1) / nullif(y2 - y1, 0) GROUP BY lat, lon, x, zone HAVING count(*) % 2 = 1),
    m AS (SELECT lat, lon, arg_min(zone, (area, zone)) AS zone FROM i JOIN z USING (zone) GROUP BY lat, lon)
    SELECT doc_id, lat, lon, coalesce(zone, 'UTC') AS zone FROM p LEFT JOIN m USING (lat, lon)"""
)
def zones_by_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zone whose outline is around each place, with holes and beyond the date line; else UTC."""
    n, i = F.col("n_nationkey"), F.col("doc_id")
    point = lambda k, r: F.struct(((n * 29 % 36) * F.lit(10.0) - 175 + _AROUND[k][0] * r).alias("lon"), ((n * 17 % 13) * F.lit(10.0) - 60 + _AROUND[k][1] * r).alias("lat"))
    rings = [F.array(*[point(k, r(k)) for k in range(12)]) for r in (lambda k: (n * 7 + k * 5) % 11 + F.lit(4.0), lambda k: F.lit(2.0))]
    outlines = table(spark, sf_dir, "nation").select(F.col("n_name").alias("zone"), F.explode(F.array(*rings)).alias("points"))
    places = table(spark, sf_dir, "documents").select(i, ((i * 37 % 1801) / F.lit(10.0) - 90).alias("lat"), ((i * 7919 % 3601) / F.lit(10.0) - 180).alias("lon"))
    return zones.zone_in_outlines(places, outlines, "UTC")


def _toy_model():
    """Stands for a model: where a vector is greatest, and how many of its components are above 0."""
    import numpy as np

    return lambda x: np.stack([x.argmax(axis=1), (x > 0).sum(axis=1)], axis=1).astype(np.float32)


@query(
    """SELECT vec_id AS key, CASE WHEN vec_id % 10 <> 7 THEN list_position(embedding, list_max(embedding)) - 1 END AS top, CASE WHEN vec_id % 10 <> 7 THEN len(list_filter(embedding, lambda v: v > 0)) END AS above,
    CASE WHEN vec_id % 10 = 7 THEN 'unreadable' END AS error FROM embeddings WHERE vec_id % 4 <> 0 OR vec_id % 12 = 0"""
)
def cached_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model says of the vectors that a cache doesn't answer; some are unreadable."""
    key = F.col("vec_id").alias("key")
    items = table(spark, sf_dir, "embeddings").select(key, F.when(F.col("vec_id") % 10 != 7, F.col("embedding")).alias("pixels"))
    cache = table(spark, sf_dir, "embeddings").filter("vec_id % 4 = 0").select(
        key, F.when(F.col("vec_id") % 12 == 4, F.array(F.lit(1.0).cast("float"))).alias("embedding"), F.when(F.col("vec_id") % 12 == 8, "failed").alias("error")
    )
    said = inference.embed_missing(items, cache, _toy_model)
    return said.select("key", F.get("embedding", F.lit(0)).cast("long").alias("top"), F.get("embedding", F.lit(1)).cast("long").alias("above"), "error")


#: The pictures again, with up to five equal ones of every fourth, of which some are new.
_COPIES = f"""{PICTURES}, c AS (SELECT z.* REPLACE (z.id * 10 + k AS id, CASE WHEN k = 0 THEN z.is_new ELSE z.id % 3 = 0 END AS is_new) FROM z, unnest(range(CASE WHEN z.id % 4 = 0 THEN 1 + z.id % 6 ELSE 1 END)) AS u(k)),
  g AS (SELECT id, bool_or(is_new) AS is_new, list(struct_pack(hi, lo, grey) ORDER BY r) AS face FROM c GROUP BY id),
  m AS (SELECT id, min(id) OVER w AS class_id, count(*) OVER w AS n, bool_or(is_new) OVER w AS any_new FROM g WINDOW w AS (PARTITION BY face))"""


def _copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = pictures(spark, sf_dir)
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("id") % 4 == 0, F.col("id") % 6).otherwise(0)))
    more = own.withColumn("k", k)
    return more.select((F.col("id") * 10 + F.col("k")).alias("id"), F.when(F.col("k") == 0, F.col("is_new")).otherwise(F.col("id") % 3 == 0).alias("is_new"), "hashes", "greys")


@query(f"WITH {_COPIES} SELECT id, class_id, n, any_new FROM m")
def picture_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal pictures as classes."""
    return similar.picture_classes(_copies(spark, sf_dir))


@query(
    f"""WITH {_COPIES}, s AS (SELECT c.*, any_new FROM c JOIN m USING (id) WHERE id = class_id),
    near AS (SELECT a.id AS a, b.id AS b, a.r AS rotation, (bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)))::int AS distance,
      (abs(a.grey[1] - b.grey[1]) + abs(a.grey[2] - b.grey[2]) + abs(a.grey[3] - b.grey[3]) + abs(a.grey[4] - b.grey[4])) / 4 AS diff
      FROM s a JOIN s b ON a.id < b.id AND b.r = 0 AND (a.any_new OR b.any_new) AND bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 3)
    SELECT a, b, arg_min(rotation, rotation)::int AS rotation, arg_min(distance, rotation) AS distance, arg_min(diff, rotation) AS diff FROM near WHERE diff <= 6 GROUP BY a, b"""
)
def class_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of equal pictures that look alike, one of either new."""
    return similar.similar_classes(_copies(spark, sf_dir))[1]
