"""Queries over the fixture tables, and the same in DuckDB SQL."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsieve.functions import names
from twinsieve.functions.vectors import clamp, doubles, half_even, hamming_elements, min_max_scale, normalize, standardize
from twinsieve.operators import curate, distances, evaluate, grouping, knn, layout, quality, threshold
from twinsieve.operators.hashing import BandedProjection, LeastProjection, SignProjection, SimilarityHash
from twinsieve.plans.dedup import dedup
from twinsieve.storage import settle, shared_dir

DIM = 64
SIGN = SignProjection(32, DIM, 0)
BANDED = BandedProjection(32, DIM, 4, 1)
LEAST = LeastProjection(16, DIM, 2)
SIM, SIM_LONG = SimilarityHash(48, DIM), SimilarityHash(128, DIM)
WITHIN, BANDED_WITHIN, K, SIMILAR = 6, 6, 10, 0.37


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _unit(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), normalize(doubles(F.col("embedding"))).alias("vec"))


def _codes(spark: SparkSession, d: str) -> DataFrame:
    return _unit(spark, d).select("id", SIGN.code("vec").alias("code"))


def _buckets(spark: SparkSession, d: str) -> DataFrame:
    return settle(distances.buckets(_codes(spark, d)), "buckets")


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return grouping.groups_within(settle(_codes(spark, d), "codes"), WITHIN, SIGN.count)


def _members(spark: SparkSession, d: str) -> DataFrame:
    """(group_id, id) with the leader's number as the group's name."""
    return settle(_groups(spark, d), "groups").select(F.concat(F.lit("g"), F.col("leader").cast("string")).alias("group_id"), "id")


def _counts(spark: SparkSession, d: str) -> DataFrame:
    label = _table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("class"))
    return settle(evaluate.confusion(_members(spark, d).join(label, "id")), "confusion")


def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _unit(spark, d).select(F.col("id").alias("vec_id"), F.posexplode("vec").alias("dim", "x")).withColumn("x", F.round("x", 6))


def minmax_scale(spark: SparkSession, d: str) -> DataFrame:
    return min_max_scale(_table(spark, d, "embeddings"), "vec_id", "embedding").withColumn("x", F.round("x", 6))


def standardized(spark: SparkSession, d: str) -> DataFrame:
    return standardize(_table(spark, d, "embeddings"), "vec_id", "embedding").withColumn("x", F.round("x", 6))


def sign_lsh_codes(spark: SparkSession, d: str) -> DataFrame:
    return _codes(spark, d).withColumnRenamed("id", "vec_id")


def sign_lsh_buckets(spark: SparkSession, d: str) -> DataFrame:
    return distances.buckets(_unit(spark, d).select("id", SignProjection(8, DIM, 0).code("vec").alias("code")))


def banded_lsh_codes(spark: SparkSession, d: str) -> DataFrame:
    return _unit(spark, d).select(F.col("id").alias("vec_id"), F.posexplode(BANDED.codes("vec")).alias("band", "code"))


def _banded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    codes = settle(_unit(spark, d).select("id", BANDED.codes("vec").alias("codes")), "codes")
    return codes, distances.banded_pairs(codes, BANDED_WITHIN)


def banded_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _banded(spark, d)[1]


def banded_leader_groups(spark: SparkSession, d: str) -> DataFrame:
    return grouping.leaders(*_banded(spark, d))


def _least(spark: SparkSession, d: str, use_median: bool) -> DataFrame:
    values = settle(LEAST.values(_unit(spark, d), "id", "vec"), "values")
    bits = LEAST.signatures(values, LEAST.fit(values), "id", use_median)
    return bits.select(F.col("id").alias("vec_id"), F.array_join(F.transform("bits", lambda b: b.cast("string")), "").alias("bits"))


def min_projection_mean(spark: SparkSession, d: str) -> DataFrame:
    return _least(spark, d, False)


def min_projection_median(spark: SparkSession, d: str) -> DataFrame:
    return _least(spark, d, True)


def simhash_idf(spark: SparkSession, d: str) -> DataFrame:
    return SimilarityHash.fit(_unit(spark, d), "vec").withColumn("idf", F.round("idf", 9))


def simhash_codes(spark: SparkSession, d: str) -> DataFrame:
    v = settle(_unit(spark, d), "vectors")
    return v.select(F.col("id").alias("vec_id"), SIM.code("vec", SimilarityHash.fit(v, "vec")).alias("code"))


def hamming_pairs(spark: SparkSession, d: str) -> DataFrame:
    return distances.hamming_pairs(_buckets(spark, d), WITHIN, SIGN.count)


def hamming_histogram(spark: SparkSession, d: str) -> DataFrame:
    return distances.histogram(_buckets(spark, d))


def threshold_percentile(spark: SparkSession, d: str) -> DataFrame:
    return threshold.percentile(hamming_histogram(spark, d))


def threshold_valley(spark: SparkSession, d: str) -> DataFrame:
    return threshold.valley(settle(hamming_histogram(spark, d), "histogram"))


def threshold_valley_smoothed(spark: SparkSession, d: str) -> DataFrame:
    """The smoothed histogram of a mixture that does have a valley: near pairs are counted a thousand times."""
    h = hamming_histogram(spark, d).select("distance", F.when(F.col("distance") < 10, F.col("cnt") * 1000).otherwise(F.col("cnt")).alias("cnt"))
    return threshold.smooth(settle(h, "histogram")).select("distance", "cnt", F.col("s").cast("long").alias("s"))


def leader_groups(spark: SparkSession, d: str) -> DataFrame:
    return _groups(spark, d)


def threshold_valley_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The first valley of that mixture; it is one between two hills, not the percentile."""
    h = hamming_histogram(spark, d).select("distance", F.when(F.col("distance") < 10, F.col("cnt") * 1000).otherwise(F.col("cnt")).alias("cnt"))
    return threshold.valley(settle(h, "histogram"))


def simhash_codes_128(spark: SparkSession, d: str) -> DataFrame:
    v = settle(_unit(spark, d), "vectors")
    return v.select(F.col("id").alias("vec_id"), SIM_LONG.code("vec", SimilarityHash.fit(v, "vec")).alias("code"))


def min_projection_stddev(spark: SparkSession, d: str) -> DataFrame:
    fitted = LEAST.fit(settle(LEAST.values(_unit(spark, d), "id", "vec"), "values"))
    return fitted.select("dim", *[F.round(c, 6).alias(c) for c in ("mean", "median", "stddev")])


def dedup_sign_lsh(spark: SparkSession, d: str) -> DataFrame:
    """The whole run, with the threshold from the histogram."""
    v = _table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return dedup(v, "sign_lsh", DIM, planes=SIGN.count, seed=SIGN.seed).groups


def dedup_knn(spark: SparkSession, d: str) -> DataFrame:
    v = _table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return dedup(v, "knn", DIM, threshold=SIMILAR, k=K).groups


def sampled(spark: SparkSession, d: str) -> DataFrame:
    """The sampling operator: 100 rows by a seeded hash of the id."""
    return distances.sample(_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label"), 100, seed=3)


def _files(spark: SparkSession, d: str) -> DataFrame:
    """(id, label, base, stem) of an image for each row of embeddings."""
    stem = F.concat(F.lit("c"), F.col("label").cast("string"), F.lit("_"), F.col("vec_id").cast("string"))
    return _table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.concat(stem, F.lit(".png")).alias("base"), stem.alias("stem"), "embedding")


def map_records(spark: SparkSession, d: str) -> DataFrame:
    """Points of the map with clusters and scores found by base name, full path or stem, or by none."""
    f = _files(spark, d)
    points = f.select(F.col("base").alias("filename"), *[F.round(F.col("embedding")[i].cast("double"), 4).alias(c) for i, c in enumerate("xyz")])
    group = F.concat(F.lit("group_"), F.col("label").cast("string"))
    files = f.where("id % 4 = 0").select(F.concat(F.lit("/in/"), "base").alias("path"), group.alias("cluster")).union(f.where("id % 4 = 1").select(F.concat(F.lit("/in/"), "stem", F.lit(".jpeg")).alias("path"), group.alias("cluster")))
    scores = f.where("id % 3 = 0").select(F.col("base").alias("path"), (F.col("id") % 90).cast("double").alias("total"))
    return layout.records(points, files, scores)


def spread_points(spark: SparkSession, d: str) -> DataFrame:
    """Given points drawn together by label, or apart: rows of the label 0 are in no cluster."""
    f = _table(spark, d, "embeddings")
    points = f.select(F.col("vec_id").alias("id"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")])
    clusters = f.where("label > 0").select(F.col("vec_id").alias("id"), F.concat(F.lit("g"), F.col("label").cast("string")).alias("cluster"))
    return layout.spread(points, clusters, "id").select("id", *[F.round(c, 6).alias(c) for c in "xyz"], "cluster")


def valid_paths(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d)
    return layout.existing(f.select(F.concat(F.lit("/in/"), "base").alias("path")), f.where("id % 3 <> 0").select(F.col("base").alias("filename")))


def member_rows(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d)
    points = f.select(F.col("id").alias("idx"), F.concat(F.lit("c"), F.col("label").cast("string"), F.lit(".png")).alias("filename"))
    members = f.where("id % 7 = 0").select(F.concat(F.lit("g"), (F.col("id") % 5).cast("string")).alias("group_id"), F.concat(F.lit("/in/c"), F.col("label").cast("string"), F.lit(".png")).alias("path"))
    return layout.member_rows(members.distinct(), points)


def score_fallback(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d)
    group = lambda n: F.concat(F.lit("g"), (F.col("id") % n).cast("string"))
    scores = f.where("id % 2 = 0").select(group(4).alias("group_id"), F.col("base").alias("path"), (F.col("id") % 50).cast("double").alias("total"))
    return layout.score_of(f.select(group(6).alias("group_id"), F.col("base").alias("path")), scores.union(scores.select(F.lit("h").alias("group_id"), "path", F.col("total") + 1)))


def image_measures(spark: SparkSession, d: str) -> DataFrame:
    """Those scores of ``image_quality`` that SQL can express: all but the ones from edges."""
    return image_quality(spark, d).select("filename", *[F.round(c, 4).alias(c) for c in ("resolution", "sharpness", "exposure", "contrast", "color_richness", "edge_integrity", "filename_bonus")])


def better_of_group(spark: SparkSession, d: str) -> DataFrame:
    f = _table(spark, d, "embeddings").select(F.concat(F.lit("g"), F.col("label").cast("string")).alias("group_id"), F.col("vec_id").alias("id"), (F.col("vec_id") * 37 % 200).cast("double").alias("sharpness"), (F.col("vec_id") * 13 % 40).cast("double").alias("saturation"))
    return quality.better_of(f)


def name_parts(spark: SparkSession, d: str) -> DataFrame:
    """Suffix, class, stem and harmless form of names made from urls."""
    name = F.concat(F.lit("../"), F.element_at(F.array(*map(F.lit, ("a_1", "b_x_2", "c", ".d"))), (F.col("page_id") % 4 + 1).cast("int")), F.element_at(F.array(*map(F.lit, (".JPG", ".png.txt", ".Jpeg", ""))), (F.col("page_id") % 5 % 4 + 1).cast("int")))
    t = _table(spark, d, "pages").select("page_id", name.alias("name"))
    base = names.basename(F.col("name"))
    return t.select("page_id", names.is_image(F.col("name")).alias("is_image"), names.label_of(base).alias("label"), names.stem(F.col("name")).alias("stem"), names.safe_name(F.col("name")).alias("safe"))


def clamped(spark: SparkSession, d: str) -> DataFrame:
    """Values held between 0 and 100, and rounded half to even."""
    x = F.col("vec_id") * F.lit(0.125) - 20
    return _table(spark, d, "embeddings").select("vec_id", clamp(x, 0.0, 100.0).alias("clamped"), half_even(x).alias("rounded"), hamming_elements(F.array("vec_id", "label"), F.array(F.lit(3).cast("long"), F.col("label"))).alias("unequal"))


def _nearest(spark: SparkSession, d: str) -> DataFrame:
    return knn.nearest(_unit(spark, d), K)


def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d).select("id", "other", F.round("sim", 6).alias("sim"), "rank")


def knn_edges(spark: SparkSession, d: str) -> DataFrame:
    return knn.edges(_nearest(spark, d), SIMILAR)


def knn_components(spark: SparkSession, d: str) -> DataFrame:
    return grouping.components(_unit(spark, d).select("id"), knn_edges(spark, d))


def group_sizes_top8(spark: SparkSession, d: str) -> DataFrame:
    return grouping.largest(_groups(spark, d))


def group_names(spark: SparkSession, d: str) -> DataFrame:
    return grouping.named(settle(_groups(spark, d), "groups"), by_size=True)


def dedup_summary(spark: SparkSession, d: str) -> DataFrame:
    return grouping.summary(_groups(spark, d)).withColumn("saved_percent", F.round("saved_percent", 6))


def eval_confusion(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d)


def eval_owner(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.owners(_counts(spark, d))


def eval_prf_macro(spark: SparkSession, d: str) -> DataFrame:
    c = _counts(spark, d)
    m = evaluate.macro(evaluate.class_scores(c, evaluate.owners(c)))
    return m.select(*[F.round(x, 9).alias(x) for x in ("precision", "recall", "f1")], "classes")


def eval_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.accuracy(_counts(spark, d)).select(F.round("accuracy", 9).alias("accuracy"))


def filename_bonus(spark: SparkSession, d: str) -> DataFrame:
    words = F.array(*[F.lit(w) for w in names.BONUS])
    name = F.concat(F.element_at(words, (F.col("page_id") % 11 + 1).cast("int")), F.lit("_"), F.element_at(words, (F.col("page_id") % 7 + 1).cast("int")), F.lit("_"), names.basename(F.col("url")))
    return _table(spark, d, "pages").select("page_id", names.filename_bonus(name).alias("bonus"))


def quality_band(spark: SparkSession, d: str) -> DataFrame:
    s = (F.col("n_chars") % 101).cast("double")
    return _table(spark, d, "documents").select("doc_id", names.quality_label(s).alias("label"), names.quality_colour(s).alias("colour"), names.traffic_light(s).alias("light"), names.cluster_colour(F.col("doc_id")).alias("cluster_colour"))


def doc_exact_dups(spark: SparkSession, d: str) -> DataFrame:
    g = _table(spark, d, "documents").select("doc_id", F.md5("text").alias("h")).groupBy("h")
    return g.agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("first_id", "n")


def best_of_group(spark: SparkSession, d: str) -> DataFrame:
    scored = _table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") % 3).cast("double").alias("total"))
    return curate.best(_members(spark, d).join(scored, "id"))


def delete_items(spark: SparkSession, d: str) -> DataFrame:
    g = _members(spark, d)
    return curate.delete(g, g.where("id % 3 = 0"))[0]


def keep_best(spark: SparkSession, d: str) -> DataFrame:
    scored = _table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") % 3).cast("double").alias("total"))
    return curate.keep_best(_members(spark, d).join(scored, "id"))[1]


def delete_group(spark: SparkSession, d: str) -> DataFrame:
    return curate.delete_group(_members(spark, d), "g0")[0]


def keep_one(spark: SparkSession, d: str) -> DataFrame:
    return curate.keep_one(_members(spark, d), "g0", -1)[0]


def move_items(spark: SparkSession, d: str) -> DataFrame:
    g = _members(spark, d)
    return curate.move(g, g.where("id % 5 = 0"), "moved")


def pca_layout(spark: SparkSession, d: str) -> DataFrame:
    v = _unit(spark, d)
    several = grouping.without_singletons(settle(_groups(spark, d), "groups")).select("id", F.concat(F.lit("g"), F.col("leader").cast("string")).alias("cluster"))
    return layout.spread(layout.project(v, "id", "vec"), several, "id")


def png(pixels: list[list[tuple[int, int, int]]]) -> bytes:
    """An uncompressed-filter RGB PNG of some pixels."""
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + bytes(v for p in row for v in p) for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", len(pixels[0]), len(pixels), 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def image_quality(spark: SparkSession, d: str) -> DataFrame:
    """Scores of one image for each row of embeddings, drawn from its vector in the tasks."""
    i, j = np.mgrid[:32, :32]
    at = np.stack([(i ^ j) % DIM, (i + j) % DIM, (i * j) % DIM], axis=-1)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = [np.clip(np.trunc(128 + 400 * np.asarray(v, float)), 0, 255).astype(np.uint8) for v in b["embedding"]]
            yield pd.DataFrame({"filename": b["filename"], "data": [v[at].tobytes() for v in x]})

    name = F.concat(F.lit("c"), F.col("label").cast("string"), F.lit("_"), F.col("vec_id").cast("string"), F.lit(".png"))
    drawn = _table(spark, d, "embeddings").select(name.alias("filename"), "embedding").mapInPandas(draw, "filename string, data binary")
    pixels = F.struct(F.lit(32).alias("height"), F.lit(32).alias("width"), F.lit(3).alias("nChannels"), "data")
    return quality.score(drawn.select("filename", pixels.alias("image")))


def streaming_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Extension: the first event of each user and type within the watermark, from a stream."""
    from twinsieve.streaming.dedup import first_occurrences, run_once

    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex[:8]}"
    schema = _table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))
    return run_once(spark, first_occurrences(stream, ["user_id", "event_type"], late="3650 days").select("user_id", "event_type"), "dedup", f"{base}/out", f"{base}/checkpoint")


def entry(spark: SparkSession, d: str) -> DataFrame:
    """Groups by 16-plane codes within 2 bits, with their sizes."""
    codes = settle(_unit(spark, d).select("id", SignProjection(16, DIM, 0).code("vec").alias("code")), "codes")
    b = distances.buckets(codes)
    g = grouping.groups_of_codes(codes, grouping.leaders(b.select(F.col("first_id").alias("id")), distances.hamming_pairs(b, 2, 16)))
    return grouping.named(settle(g, "groups"))


_NOT_QUERIES = {"clamp", "dedup", "doubles", "min_max_scale", "normalize", "standardize", "images", "settle", "shared_dir", "entry", "png", "queries", "oracle_sql"}


def queries() -> dict:
    return {k: f for k, f in globals().items() if callable(f) and not k.startswith("_") and k not in _NOT_QUERIES and getattr(f, "__module__", "") == __name__}


def _list(x) -> str:
    return "[" + ", ".join(repr(float(v)) for v in x) + "]"


def _planes(h) -> str:
    return "(VALUES " + ", ".join(f"({i}, {_list(r)})" for i, r in enumerate(h)) + ") p(i, h)"


_E = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS f FROM embeddings)"
_U = f"{_E}, u AS (SELECT vec_id AS id, label, list_transform(f, lambda x: x / CASE WHEN list_dot_product(f, f) = 0 THEN 1e-7 ELSE sqrt(list_dot_product(f, f)) END) AS v FROM e)"
_LONG = "SELECT id, unnest(range(0, len(v))) AS dim, unnest(v) AS x FROM u"


def _code_sql(h) -> str:
    return f"SELECT id, CAST(sum(CASE WHEN list_dot_product(v, h) > 0 THEN 1::BIGINT << i ELSE 0 END) AS BIGINT) AS code FROM u, {_planes(h)} GROUP BY id"


def _leader_sql(nodes: str, near: str) -> str:
    """A scan in id order that carries the list of leaders. nodes: (id, c) numbered by n; near: the test of x.c and y.c."""
    return f"""no AS ({nodes}), num AS (SELECT *, row_number() OVER (ORDER BY id) AS n FROM no),
scan AS (SELECT 0::BIGINT AS n, CAST([] AS BIGINT[]) AS l UNION ALL
 SELECT s.n + 1, CASE WHEN EXISTS (SELECT 1 FROM num y WHERE list_contains(s.l, y.id) AND {near}) THEN s.l ELSE list_append(s.l, x.id) END FROM scan s JOIN num x ON x.n = s.n + 1),
last AS (SELECT l FROM scan ORDER BY n DESC LIMIT 1),
lead AS (SELECT x.id, CASE WHEN list_contains((SELECT l FROM last), x.id) THEN x.id ELSE (SELECT min(y.id) FROM num y WHERE y.id < x.id AND list_contains((SELECT l FROM last), y.id) AND {near}) END AS leader FROM num x)"""


def oracle_sql() -> dict[str, str]:
    sign = f"WITH RECURSIVE {_U}, c AS ({_code_sql(SIGN.planes)})"
    buckets = f"{sign}, b AS (SELECT code, min(id) AS first_id, count(*) AS n FROM c GROUP BY code)"
    groups = f"{buckets}, " + _leader_sql("SELECT first_id AS id, code AS c FROM b", f"bit_count(xor(x.c, y.c)) <= {WITHIN}") + ", g AS (SELECT c.id, leader FROM c JOIN b USING (code) JOIN lead ON lead.id = first_id)"
    members = f"{groups}, m AS (SELECT 'g' || leader AS group_id, id FROM g)"
    counts = f"{members}, k AS (SELECT group_id, 'c' || label AS class, count(*) AS n FROM m JOIN u USING (id) GROUP BY ALL)"
    cand = f"{counts}, t AS (SELECT *, max(n) OVER (PARTITION BY group_id) AS most FROM k), t2 AS (SELECT *, max(n) OVER (PARTITION BY class) AS best FROM t WHERE n = most), cand AS (SELECT class, group_id, n, row_number() OVER (PARTITION BY class ORDER BY group_id) AS place FROM t2 WHERE n = best)"
    owner = f"{cand}, f AS (SELECT class, group_id, min(class) OVER (PARTITION BY group_id) AS winner FROM cand WHERE place = 1), own AS (SELECT a.class, CASE WHEN f.class = winner THEN f.group_id ELSE s.group_id END AS group_id FROM (SELECT DISTINCT class FROM k) a LEFT JOIN f ON a.class = f.class LEFT JOIN (SELECT class, group_id FROM cand WHERE place = 2) s ON a.class = s.class)"
    hist = f"{buckets}, raw AS (SELECT bit_count(xor(x.code, y.code)) AS distance, sum(x.n * y.n) AS cnt FROM b x JOIN b y ON x.first_id < y.first_id GROUP BY 1 UNION ALL SELECT 0, sum(n * (n - 1) // 2) FROM b WHERE n > 1 HAVING count(*) > 0), h AS (SELECT CAST(d AS INT) AS distance, CAST(coalesce((SELECT sum(cnt) FROM raw WHERE distance = d), 0) AS BIGINT) AS cnt FROM (SELECT unnest(range((SELECT min(distance) FROM raw), (SELECT max(distance) FROM raw) + 1)) AS d))"
    w = threshold.kernel(1.5)
    kern = "(VALUES " + ", ".join(f"({i - len(w) // 2}, {x!r}::DOUBLE)" for i, x in enumerate(w)) + ") kern(o, w)"
    smooth = lambda h: f"sm AS (SELECT a.distance, a.cnt, floor(list_sum(list(w * b.cnt ORDER BY o)) + 1e-9) AS s FROM {h} a, {kern}, {h} b, (SELECT min(distance) AS lo, count(*) AS len FROM {h}) z WHERE b.distance = lo + least(((a.distance - lo + o) % (2 * len) + 2 * len) % (2 * len), 2 * len - 1 - ((a.distance - lo + o) % (2 * len) + 2 * len) % (2 * len)) GROUP BY a.distance, a.cnt)"
    pct = "(SELECT CAST(floor(quantile_cont(distance, 0.1)) AS INT) FROM (SELECT distance, unnest(range(cnt)) FROM h))"
    near = {k: f"coalesce(lag(s, {k}) OVER o, first(s) OVER o) AS a{k}, coalesce(lead(s, {k}) OVER o, last(s) OVER (ORDER BY distance ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS b{k}" for k in (1, 2)}
    low, high = LEAST.extremes
    vals = f"WITH {_U}, l AS ({_LONG}), val AS (SELECT id, dim, x * CASE WHEN x >= 0 THEN {_list(low)}[dim + 1] ELSE {_list(high)}[dim + 1] END AS v FROM l), st AS (SELECT dim, avg(v) AS mean, median(v) AS med FROM val GROUP BY dim)"
    bits = lambda test: f"{vals} SELECT id AS vec_id, string_agg(CASE WHEN {test} THEN '1' ELSE '0' END, '' ORDER BY dim) AS bits FROM val JOIN st USING (dim) GROUP BY id"
    per = BANDED.count // BANDED.bands
    band = f"bc AS (SELECT id, CAST(i // {per} AS INT) AS band, CAST(sum(CASE WHEN list_dot_product(v, h) > 0 THEN 1::BIGINT << (i % {per}) ELSE 0 END) AS BIGINT) AS code FROM u, {_planes(BANDED.planes)} GROUP BY ALL)"
    pairs = f"WITH RECURSIVE {_U}, {band}, bp AS (SELECT DISTINCT x.id AS a, y.id AS b FROM bc x JOIN bc y ON x.code = y.code AND x.id < y.id), bd AS (SELECT a, b, CAST(sum(bit_count(xor(x.code, y.code))) AS INT) AS d FROM bp JOIN bc x ON x.id = a JOIN bc y ON y.id = b AND y.band = x.band GROUP BY a, b HAVING sum(bit_count(xor(x.code, y.code))) <= {BANDED_WITHIN})"
    idf = f"WITH {_U}, l AS ({_LONG}), idf AS (SELECT dim, ln(count(*) / (1 + count(*) FILTER (WHERE x > 1e-9))) AS idf FROM l GROUP BY dim)"
    pat = SIM.patterns()
    words = [[sum(1 << j for j in range(SIM.bits) if pat[i, t, j] > 0) for t in range(4)] for i in range(DIM)]
    phi = "(VALUES " + ", ".join(f"({i}, {r})" for i, r in enumerate(words)) + ") phi(pd, ws)"
    token = "CASE WHEN x <= -0.5 THEN 1 WHEN x >= 0.5 THEN 4 WHEN x < 0 THEN 2 ELSE 3 END"
    sim = f"{idf}, wt AS (SELECT id, x * idf AS w, CAST(ws[{token}] AS BIGINT) AS word FROM l JOIN idf USING (dim) JOIN {phi} ON pd = dim WHERE abs(x * idf) >= 1e-9), acc AS (SELECT id, j, sum(CASE WHEN (word >> j) & 1 = 1 THEN w ELSE -w END) AS a FROM wt, (SELECT CAST(unnest(range({SIM.bits})) AS INT) AS j) GROUP BY id, j)"
    top = f"WITH RECURSIVE {_U}, s AS (SELECT x.id, y.id AS other, list_dot_product(x.v, y.v) AS sim FROM u x JOIN u y ON x.id <> y.id), nn AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY sim DESC, other) AS INT) AS rank FROM s QUALIFY rank <= {K - 1})"
    ed = f"{top}, ed AS (SELECT DISTINCT least(id, other) AS a, greatest(id, other) AS b FROM nn WHERE sim >= {SIMILAR})"
    pat2 = SIM_LONG.patterns()
    words2 = [[sum(1 << j for j in range(64) if pat2[i, t, j] > 0) for t in range(4)] for i in range(DIM)]
    phi2 = "(VALUES " + ", ".join(f"({i}, [" + ", ".join(f"{w}::UBIGINT" for w in r) + "])" for i, r in enumerate(words2)) + ") phi(pd, ws)"
    sim2 = f"{idf}, wt AS (SELECT id, x * idf AS w, ws[{token}] AS word FROM l JOIN idf USING (dim) JOIN {phi2} ON pd = dim WHERE abs(x * idf) >= 1e-9), acc AS (SELECT id, j, sum(CASE WHEN (word >> CAST(j AS UBIGINT)) & 1 = 1 THEN w ELSE -w END) AS a FROM wt, (SELECT CAST(unnest(range(64)) AS INT) AS j) GROUP BY id, j), cs AS (SELECT id, sum(CASE WHEN a >= 0 THEN 1::HUGEINT << (63 - j) ELSE 0::HUGEINT END) AS c FROM acc GROUP BY id)"
    mins = f"minima AS (SELECT list(distance ORDER BY distance) AS ats FROM nb WHERE s < a1 AND s < b1 AND s < a2 AND s < b2)"
    valley = lambda h, p: f"{smooth(h)}, nb AS (SELECT distance, s, {near[1]}, {near[2]} FROM sm WINDOW o AS (ORDER BY distance)), {mins}, sp AS (SELECT min(distance) AS lo, max(distance) AS hi FROM {h}), thr AS (SELECT CAST(CASE WHEN hi - lo < 2 THEN lo ELSE coalesce(CASE WHEN ats[1] < lo + 2 AND len(ats) > 1 THEN ats[2] ELSE ats[1] END, {p}) END AS INT) AS threshold FROM minima, sp)"
    sized = "z AS (SELECT leader, count(*) AS size FROM g GROUP BY leader)"
    comp = f"{ed}, re AS (SELECT id AS x, id AS y FROM u UNION SELECT re.x, q.b FROM re JOIN (SELECT a, b FROM ed UNION ALL SELECT b, a FROM ed) q ON re.y = q.a), g AS (SELECT x AS id, min(y) AS leader FROM re GROUP BY x)"
    files = "f AS (SELECT vec_id AS id, label, 'c' || label || '_' || vec_id AS stem, 'c' || label || '_' || vec_id || '.png' AS base, embedding FROM embeddings)"
    px = """px AS (SELECT vec_id, label, p // 32 AS i, p % 32 AS j, list_transform([xor(p // 32, p % 32) % 64, (p // 32 + p % 32) % 64, ((p // 32) * (p % 32)) % 64], lambda a: CAST(greatest(least(trunc(128 + 400 * CAST(embedding[a + 1] AS DOUBLE)), 255), 0) AS INT)) AS c FROM embeddings, (SELECT unnest(range(1024)) AS p)),
gr AS (SELECT vec_id, label, i, j, floor(c[1] * 0.114::DOUBLE + c[2] * 0.587::DOUBLE + c[3] * 0.299::DOUBLE + 0.5::DOUBLE) AS g, (c[3] - c[2] + 256) % 256 AS d1, (c[3] - c[1] + 256) % 256 AS d2, (c[2] - c[1] + 256) % 256 AS d3 FROM px),
im AS (SELECT vec_id, any_value(label) AS label, avg(g) AS light, stddev_pop(g) AS dev, (stddev_pop(d1) + stddev_pop(d2) + stddev_pop(d3)) / 3 AS colour, list(g ORDER BY i, j) AS l,
 CAST(avg(g) FILTER (WHERE i < 3 AND j < 3) < 30 AS INT) + CAST(avg(g) FILTER (WHERE i < 3 AND j > 28) < 30 AS INT) + CAST(avg(g) FILTER (WHERE i > 28 AND j < 3) < 30 AS INT) + CAST(avg(g) FILTER (WHERE i > 28 AND j > 28) < 30 AS INT) AS black FROM gr GROUP BY vec_id),
lp AS (SELECT vec_id, var_pop(l[32 * CASE i WHEN 0 THEN 1 ELSE i - 1 END + j + 1] + l[32 * CASE i WHEN 31 THEN 30 ELSE i + 1 END + j + 1] + l[32 * i + CASE j WHEN 0 THEN 1 ELSE j - 1 END + 1] + l[32 * i + CASE j WHEN 31 THEN 30 ELSE j + 1 END + 1] - 4 * l[32 * i + j + 1]) AS v FROM im, (SELECT unnest(range(32)) AS i), (SELECT unnest(range(32)) AS j) GROUP BY vec_id)"""
    made = "t AS (SELECT page_id, '../' || ['a_1', 'b_x_2', 'c', '.d'][page_id % 4 + 1] || ['.JPG', '.png.txt', '.Jpeg', ''][page_id % 5 % 4 + 1] AS name FROM pages)"
    words_sql = "[" + ", ".join(f"'{w}'" for w in names.BONUS) + "]"
    name = f"lower({words_sql}[page_id % 11 + 1] || '_' || {words_sql}[page_id % 7 + 1] || '_' || regexp_extract(url, '[^/]*$'))"
    case = lambda i: "CASE " + " ".join(f"WHEN s >= {b[0]} THEN '{b[i]}'" for b in names.BANDS) + f" ELSE '{names.LOWEST[i - 1]}' END"
    palette = "[" + ", ".join(f"'{c}'" for c in names.PALETTE) + "]"
    score = "m JOIN (SELECT vec_id AS id, CAST(label % 3 AS DOUBLE) AS total FROM embeddings) q USING (id)"
    best = f"{members}, r AS (SELECT group_id, id, total, row_number() OVER (PARTITION BY group_id ORDER BY total DESC, id) AS place FROM {score})"
    acc = f"""{cand}, an AS (SELECT class, max(n) AS top FROM k GROUP BY class), opt AS (SELECT class, list(group_id ORDER BY place) AS of FROM cand JOIN an USING (class) WHERE place = 1 OR n = top GROUP BY class),
ord AS (SELECT *, row_number() OVER (ORDER BY class) AS n FROM opt),
go AS (SELECT 0::BIGINT AS n, CAST([] AS VARCHAR[]) AS taken, CAST(NULL AS VARCHAR) AS class, CAST(NULL AS VARCHAR) AS own UNION ALL
 SELECT go.n + 1, list_append(taken, list_filter(of, lambda q: NOT list_contains(taken, q))[1]), ord.class, list_filter(of, lambda q: NOT list_contains(taken, q))[1] FROM go JOIN ord ON ord.n = go.n + 1)"""
    return {
        "l2_normalize": f"WITH {_U} SELECT id AS vec_id, CAST(dim AS INT) AS dim, round(x, 6) AS x FROM ({_LONG})",
        "minmax_scale": f"WITH {_E}, u AS (SELECT vec_id AS id, f AS v FROM e), l AS ({_LONG}) SELECT id AS vec_id, CAST(dim AS INT) AS dim, round((x - min(x) OVER (PARTITION BY dim)) / (max(x) OVER (PARTITION BY dim) - min(x) OVER (PARTITION BY dim) + 1e-10), 6) AS x FROM l",
        "standardized": f"WITH {_E}, u AS (SELECT vec_id AS id, f AS v FROM e), l AS ({_LONG}) SELECT id AS vec_id, CAST(dim AS INT) AS dim, round((x - avg(x) OVER (PARTITION BY dim)) / stddev_pop(x) OVER (PARTITION BY dim), 6) AS x FROM l",
        "sign_lsh_codes": f"{sign} SELECT id AS vec_id, code FROM c",
        "sign_lsh_buckets": f"WITH {_U}, c AS ({_code_sql(SignProjection(8, DIM, 0).planes)}) SELECT code, min(id) AS first_id, count(*) AS n FROM c GROUP BY code",
        "banded_lsh_codes": f"WITH {_U}, {band} SELECT id AS vec_id, band, code FROM bc",
        "banded_candidates": f"{pairs} SELECT * FROM bd",
        "banded_leader_groups": f"{pairs}, " + _leader_sql("SELECT id, 0 AS c FROM u", "EXISTS (SELECT 1 FROM bd WHERE (bd.a = x.id AND bd.b = y.id) OR (bd.a = y.id AND bd.b = x.id))") + " SELECT id, leader FROM lead",
        "min_projection_mean": bits("v > mean"), "min_projection_median": bits("v >= med"),
        "simhash_idf": f"{idf} SELECT CAST(dim AS INT) AS dim, round(idf, 9) AS idf FROM idf",
        "simhash_codes": f"{sim} SELECT id AS vec_id, CAST(sum(CASE WHEN a >= 0 THEN 1::BIGINT << ({SIM.bits - 1} - j) ELSE 0 END) AS BIGINT) AS code FROM acc GROUP BY id",
        "hamming_pairs": f"{buckets} SELECT x.first_id AS a, y.first_id AS b, CAST(bit_count(xor(x.code, y.code)) AS INT) AS d FROM b x JOIN b y ON x.first_id < y.first_id WHERE bit_count(xor(x.code, y.code)) <= {WITHIN}",
        "hamming_histogram": f"{hist} SELECT * FROM h", "threshold_percentile": f"{hist} SELECT {pct} AS threshold",
        "threshold_valley": f"{hist}, {smooth('h')}, nb AS (SELECT distance, s, {near[1]}, {near[2]} FROM sm WINDOW o AS (ORDER BY distance)), mi AS (SELECT list(distance ORDER BY distance) AS ats FROM nb WHERE s < a1 AND s < b1 AND s < a2 AND s < b2), sp AS (SELECT min(distance) AS lo, max(distance) AS hi FROM h) SELECT CAST(CASE WHEN hi - lo < 2 THEN lo ELSE coalesce(CASE WHEN ats[1] < lo + 2 AND len(ats) > 1 THEN ats[2] ELSE ats[1] END, {pct}) END AS INT) AS threshold FROM mi, sp",
        "threshold_valley_smoothed": f"{hist}, h2 AS (SELECT distance, CASE WHEN distance < 10 THEN cnt * 1000 ELSE cnt END AS cnt FROM h), {smooth('h2')} SELECT distance, cnt, CAST(s AS BIGINT) AS s FROM sm",
        "leader_groups": f"{groups} SELECT id, leader FROM g", "knn_topk": f"{top} SELECT id, other, round(sim, 6) AS sim, rank FROM nn", "knn_edges": f"{ed} SELECT a, b FROM ed",
        "knn_components": f"{ed}, re AS (SELECT id AS x, id AS y FROM u UNION SELECT re.x, q.b FROM re JOIN (SELECT a, b FROM ed UNION ALL SELECT b, a FROM ed) q ON re.y = q.a) SELECT x AS id, min(y) AS leader FROM re GROUP BY x",
        "group_sizes_top8": f"{groups} SELECT leader, count(*) AS size FROM g GROUP BY leader ORDER BY size DESC, leader LIMIT 8",
        "group_names": f"{groups}, z AS (SELECT leader, count(*) AS size FROM g GROUP BY leader), y AS (SELECT *, format('group_{{:03d}}', row_number() OVER (ORDER BY size DESC, leader) - 1) AS group_id FROM z) SELECT id, leader, group_id, size FROM g JOIN y USING (leader)",
        "dedup_summary": f"{groups}, z AS (SELECT leader, count(*) AS size FROM g GROUP BY leader) SELECT CAST(sum(size) AS BIGINT) AS total_items, count(*) AS n_groups, CAST(coalesce(sum(size) FILTER (WHERE size > 1), 0) AS BIGINT) AS grouped_items, CAST(sum(size) - count(*) AS BIGINT) AS redundant_items, round((sum(size) - count(*)) * 100.0 / sum(size), 6) AS saved_percent, max(size) AS largest FROM z",
        "eval_confusion": f"{counts} SELECT group_id, class, n FROM k", "eval_owner": f"{owner} SELECT class, group_id FROM own",
        "eval_prf_macro": f"{owner}, sc AS (SELECT own.class, coalesce((SELECT sum(n) FROM k WHERE k.group_id = own.group_id), 0) AS p, (SELECT sum(n) FROM k WHERE k.class = own.class) AS t, coalesce((SELECT sum(n) FROM k WHERE k.class = own.class AND k.group_id = own.group_id), 0) AS c FROM own), pr AS (SELECT CASE WHEN p > 0 THEN c / p ELSE 0 END AS pre, CASE WHEN t > 0 THEN c / t ELSE 0 END AS rec FROM sc) SELECT round(avg(pre), 9) AS precision, round(avg(rec), 9) AS recall, round(avg(CASE WHEN pre + rec > 0 THEN 2 * pre * rec / (pre + rec) ELSE 0 END), 9) AS f1, count(*) AS classes FROM pr",
        "eval_accuracy": f"{acc} SELECT round(coalesce((SELECT sum(k.n) FROM k JOIN go ON go.class = k.class AND go.own = k.group_id), 0) * 100.0 / (SELECT sum(n) FROM k), 9) AS accuracy",
        "filename_bonus": f"SELECT page_id, CAST(greatest(-100, least(30, " + " + ".join(f"CASE WHEN contains({name}, '{w}') THEN {v} ELSE 0 END" for w, v in names.BONUS.items()) + ")) AS DOUBLE) AS bonus FROM pages",
        "quality_band": f"SELECT doc_id, {case(1)} AS label, {case(2)} AS colour, CASE WHEN s >= 80 THEN '{names.LIGHTS[0][1]}' WHEN s >= 50 THEN '{names.LIGHTS[1][1]}' ELSE '{names.LOW_LIGHT}' END AS light, {palette}[doc_id % 8 + 1] AS cluster_colour FROM (SELECT doc_id, n_chars % 101 AS s FROM documents)",
        "doc_exact_dups": "SELECT min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1",
        "best_of_group": f"{best} SELECT group_id, id, total FROM r WHERE place = 1", "keep_best": f"{best} SELECT id FROM r WHERE place > 1",
        "delete_items": f"{members} SELECT group_id, id FROM m WHERE id % 3 <> 0", "delete_group": f"{members} SELECT group_id, id FROM m WHERE group_id <> 'g0'",
        "keep_one": f"{members} SELECT group_id, id FROM m WHERE group_id <> 'g0' UNION ALL SELECT 'g0', -1",
        "move_items": f"{members} SELECT group_id, id FROM m WHERE id % 5 <> 0 UNION ALL SELECT 'moved', id FROM m WHERE id % 5 = 0",
        "threshold_valley_mixture": f"{hist}, h2 AS (SELECT distance, CASE WHEN distance < 10 THEN cnt * 1000 ELSE cnt END AS cnt FROM h), {valley('h2', pct.replace('FROM h)', 'FROM h2)'))} SELECT threshold FROM thr",
        "simhash_codes_128": f"{sim2} SELECT id AS vec_id, CAST(CASE WHEN c >= 9223372036854775808::HUGEINT THEN c - 18446744073709551616::HUGEINT ELSE c END AS BIGINT) AS code FROM cs",
        "min_projection_stddev": f"{vals}, sd AS (SELECT dim, greatest(stddev_pop(v), 1e-12) AS stddev FROM val GROUP BY dim) SELECT CAST(dim AS INT) AS dim, round(mean, 6) AS mean, round(med, 6) AS median, round(stddev, 6) AS stddev FROM st JOIN sd USING (dim)",
        "dedup_sign_lsh": f"{hist}, {valley('h', pct)}, " + _leader_sql("SELECT first_id AS id, code AS c FROM b", "bit_count(xor(x.c, y.c)) <= (SELECT threshold FROM thr)") + f", g AS (SELECT c.id, leader FROM c JOIN b USING (code) JOIN lead ON lead.id = first_id), {sized}, y AS (SELECT *, format('group_{{:03d}}', row_number() OVER (ORDER BY leader) - 1) AS group_id FROM z) SELECT id, leader, group_id, size FROM g JOIN y USING (leader)",
        "dedup_knn": f"{comp}, {sized}, y AS (SELECT *, format('group_{{:03d}}', row_number() OVER (ORDER BY size DESC, leader) - 1) AS group_id FROM z) SELECT id, leader, group_id, size FROM g JOIN y USING (leader)",
        "sampled": "SELECT vec_id AS id, label FROM embeddings ORDER BY md5(vec_id || ':3'), vec_id LIMIT 100",
        "map_records": f"WITH {files} SELECT round(CAST(embedding[1] AS DOUBLE), 4) AS x, round(CAST(embedding[2] AS DOUBLE), 4) AS y, round(CAST(embedding[3] AS DOUBLE), 4) AS z, base AS filename, CASE WHEN id % 4 < 2 THEN 'group_' || label || '/' || base ELSE base END AS path, CASE WHEN id % 4 < 2 THEN 'group_' || label ELSE 'Noise/Unique' END AS cluster, CASE WHEN id % 3 = 0 THEN CAST(id % 90 AS DOUBLE) ELSE 50.0::DOUBLE END AS quality FROM f",
        "spread_points": "WITH p AS (SELECT vec_id AS id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings), m AS (SELECT label, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM p GROUP BY label) SELECT id, " + ", ".join(f"round(CASE WHEN label > 0 THEN c{c} * 10 + ({c} - c{c}) * 30 ELSE {c} * 15 END, 6) AS {c}" for c in "xyz") + ", CASE WHEN label > 0 THEN 'g' || label ELSE 'Noise/Unique' END AS cluster FROM p JOIN m USING (label)",
        "valid_paths": f"WITH {files} SELECT '/in/' || base AS path FROM f WHERE id % 3 <> 0",
        "member_rows": "WITH m AS (SELECT DISTINCT 'g' || (vec_id % 5) AS group_id, label FROM embeddings WHERE vec_id % 7 = 0) SELECT group_id, '/in/c' || m.label || '.png' AS path, max(vec_id) AS idx FROM m JOIN embeddings e ON e.label = m.label GROUP BY ALL",
        "score_fallback": f"WITH {files} SELECT 'g' || (id % 6) AS group_id, base AS path, CASE WHEN id % 2 = 0 THEN CAST(id % 50 AS DOUBLE) END AS total FROM f",
        "image_measures": f"WITH {px} SELECT 'c' || label || '_' || vec_id || '.png' AS filename, round(least(100, 1024 / 1e6::DOUBLE / 12 * 100), 4) AS resolution, round(least(100.0::DOUBLE, v / 500 * 100), 4) AS sharpness, round(greatest(0.0::DOUBLE, 100 - abs(light - 127) / 127 * 100), 4) AS exposure, round(least(100.0::DOUBLE, dev / 70 * 100), 4) AS contrast, round(CASE WHEN colour < 5 THEN 0.0::DOUBLE WHEN colour > 30 THEN 100.0::DOUBLE ELSE colour / 30 * 100 END, 4) AS color_richness, CAST([100, 80, 40, 0, 0][black + 1] AS DOUBLE) AS edge_integrity, 0.0::DOUBLE AS filename_bonus FROM im JOIN lp USING (vec_id)",
        "better_of_group": "SELECT group_id, id FROM (SELECT 'g' || label AS group_id, vec_id AS id, row_number() OVER (PARTITION BY label ORDER BY (vec_id * 37 % 200 > 100 AND vec_id * 13 % 40 > 20) DESC, vec_id * 37 % 200 DESC, vec_id) AS r FROM embeddings) WHERE r = 1",
        "name_parts": f"WITH {made}, q AS (SELECT *, regexp_extract(name, '[^/]*$') AS b FROM t) SELECT page_id, regexp_matches(lower(name), '[.](jpg|jpeg|png)$') AS is_image, split_part(b, '_', 1) AS label, regexp_replace(b, '[.][^.]*$', '') AS stem, replace(replace(name, '..', ''), '/', '_') AS safe FROM q",
        "clamped": "SELECT vec_id, greatest(0.0::DOUBLE, least(100.0::DOUBLE, vec_id * 0.125::DOUBLE - 20)) AS clamped, round_even(vec_id * 0.125::DOUBLE - 20, 2) AS rounded, CAST(vec_id <> 3 AS INT) AS unequal FROM embeddings",
        "streaming_dedup": "SELECT DISTINCT user_id, event_type FROM events",
    }
