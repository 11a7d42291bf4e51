import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinsieve.functions import murmur, pixels, vectors
from twinsieve.operators import curate, distances, evaluate, grouping, hashing, quality, threshold
from twinsieve.operators.features import GridExtractor, extract
from twinsieve.operators.hashing import BandedProjection, SignProjection, SimilarityHash
from twinsieve.plans.dedup import METHODS, dedup, lines, report
from twinsieve.queries import png, queries
from twinsieve.sources import images as src
from twinsieve.sources import sinks
from twinsieve.storage import settle


def test_murmur_known_values():
    assert murmur.x64_128(b"") == (0, 0)
    assert "%016x%016x" % murmur.x64_128(b"The quick brown fox jumps over the lazy dog") == "e34bbc7bbc071b6c7a433ca9c49a9347"
    assert murmur.x86_32(b"") == 0 and murmur.x86_32(b"", 1) == 0x514E28B7


def test_normalize_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>")
    r = df.select(vectors.normalize(F.col("v")).alias("g"), vectors.normalize(F.col("v"), "nan").alias("n")).collect()
    assert r[0].g == [0, 0] and all(np.isnan(r[0].n)) and r[1].g == [0.6, 0.8] == r[1].n


def test_shift_width_and_bands(spark):
    x = np.random.default_rng(3).standard_normal((20, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    for n in (31, 32, 36, 64):
        f = SignProjection(n, 5, 1)
        want = [sum(1 << i for i, b in enumerate(v @ f.planes.T > 0) if b) for v in x]
        got = [r.c % (1 << 64) for r in df.orderBy("id").select(f.code("vec").alias("c")).collect()]
        assert got == want
    with pytest.raises(ValueError):
        SignProjection(65, 5)
    assert {tuple(r.c) for r in df.select(BandedProjection(3, 5, 4).codes("vec").alias("c")).collect()} == {(0, 0, 0, 0)}


def test_similarity_hash_zero_is_ones(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.6, -0.8])], "id long, vec array<double>")
    for bits in (48, 64, 73, 128):
        r = df.orderBy("id").select(SimilarityHash(bits, 2).code("vec", SimilarityHash.fit(df, "vec")).alias("c")).collect()
        assert r[0].c == (-1 if bits >= 64 else (1 << bits) - 1)


def test_leaders_equal_a_scan(spark):
    rng = random.Random(5)
    for within in (0, 1, 3):
        codes = [rng.getrandbits(10) for _ in range(60)]
        want, heads = {}, []
        for i, c in enumerate(codes):
            head = next((h for h in heads if bin(codes[h] ^ c).count("1") <= within), None)
            want[i] = i if head is None else head
            heads += [i] if head is None else []
        df = spark.createDataFrame(list(enumerate(codes)), "id long, code long")
        b = distances.buckets(df)
        lead = grouping.leaders(b.select(F.col("first_id").alias("id")), distances.hamming_pairs(b, within, 10))
        assert {r.id: r.leader for r in grouping.groups_of_codes(df, lead).collect()} == want
        if within == 1:
            by_rounds = grouping.leaders(b.select(F.col("first_id").alias("id")), distances.hamming_pairs(b, within, 10), rest=0)
            assert sorted(map(tuple, by_rounds.collect())) == sorted(map(tuple, lead.collect()))


def test_narrow_bands_are_not_joined(spark):
    """A band of four or five bits leaves a third of all pairs as candidates; such codes meet in blocks, without a join."""
    rng = random.Random(4)
    rows = [(i, rng.getrandbits(32)) for i in range(0, 3000, 3)]
    rows += [(i + 1, c ^ 1 << 31 ^ 1 << i % 29) for i, c in rows[:200]]
    near = distances.hamming_pairs(spark.createDataFrame(rows, "first_id long, code long"), 6, 32)
    assert "Join" not in near._jdf.queryExecution().optimizedPlan().toString()
    ids, codes = (np.array(x, np.int64) for x in zip(*sorted(rows), strict=True))
    d = np.bitwise_count(codes[:, None] ^ codes[None, :])
    a, b = np.nonzero(np.triu(d <= 6, 1))
    assert len(a) >= 200 and sorted(map(tuple, near.collect())) == sorted(zip(ids[a].tolist(), ids[b].tolist(), d[a, b].tolist(), strict=True))


def test_leaders_of_codes_equal_those_of_pairs(spark):
    """Rounds of any size, codes with the highest bit, and distances from none to nearly all."""
    rng = random.Random(9)
    codes = [rng.getrandbits(8) | (i % 2) << 63 for i in range(90)]
    rows = [(i * 5 - 200, c - (1 << 64) if c >> 63 else c) for i, c in enumerate(codes)]
    b = settle(distances.buckets(spark.createDataFrame(rows, "id long, code long")), "buckets")
    first = {r.code: r.first_id for r in b.collect()}
    for within, size in ((0, 1 << 15), (1, 7), (2, 20), (2, len(first)), (8, 7)):
        order = sorted(first, key=first.get)
        near = [(first[x], first[y]) for i, x in enumerate(order) for y in order[i + 1 :] if ((x ^ y) & (1 << 64) - 1).bit_count() <= within]
        pairs = spark.createDataFrame(near, "a long, b long")
        want = {r.id: r.leader for r in grouping.leaders(b.select(F.col("first_id").alias("id")), pairs).collect()}
        got = grouping.leaders_of_codes(b, within, size).collect()
        assert len(got) == len(first) and {first[r.code]: r.leader for r in got} == want
    assert grouping.leaders_of_codes(b.limit(0), 3).count() == 0


#: Queries on groups of codes.
GROUPED = ("leader_groups", "best_of_group", "dedup_summary", "delete_group", "delete_items", "eval_accuracy", "eval_confusion", "eval_prf_macro", "group_names", "group_sizes_top8", "keep_one", "move_items")


@pytest.mark.parametrize("name", GROUPED)
def test_groups_are_found_without_pairs(spark, monkeypatch, name):
    """Pairs grow with the square of the rows; a code is compared with leaders and its own round, and no pair is a row."""

    def made(*_args, **_more):
        raise AssertionError("pairs as rows")

    monkeypatch.setattr(distances, "hamming_pairs", made)
    monkeypatch.setattr(grouping, "leaders", made)
    assert queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_length_is_worked_out_once_a_vector(spark):
    """The length is no part of what is done for each component."""
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, []), (3, None), (4, [0.0, 0.0])], "i int, v array<double>")
    unit = df.select("i", *[vectors.normalize(F.col("v"), z).alias(z) for z in ("guard", "keep")])
    got = {r.i: (r.guard, r.keep) for r in unit.collect()}
    assert got == {1: ([0.6, 0.8],) * 2, 2: ([],) * 2, 3: (None,) * 2, 4: ([0.0, 0.0],) * 2}
    long = spark.range(4).select(F.array_repeat(F.lit(1.0), 10_000).alias("v")).coalesce(1)
    began = time.monotonic()
    assert long.select(F.array_max(vectors.normalize(F.col("v"))).alias("x")).agg(F.max("x")).first()[0] == 0.01
    assert time.monotonic() - began < 20


def test_chain_leaders_and_components(spark):
    nodes, edges = spark.createDataFrame([(i,) for i in (1, 2, 3, 9)], "id long"), spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    assert {r.id: r.leader for r in grouping.leaders(nodes, edges).collect()} == {1: 1, 2: 1, 3: 3, 9: 9}
    assert {r.id: r.leader for r in grouping.components(nodes, edges).collect()} == {1: 1, 2: 1, 3: 1, 9: 9}
    assert grouping.leaders(nodes.limit(0), edges.limit(0)).count() == 0


def test_blocks_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(distances, "BLOCK", 16)
    rng = random.Random(9)
    rows = [(i, rng.getrandbits(64) - (1 << 63), [rng.getrandbits(9), rng.getrandbits(9)], rng.randint(1, 4)) for i in range(70)]
    df = spark.createDataFrame(rows, "first_id long, code long, codes array<long>, n long")
    apart = [(x[0], y[0], (x[1] ^ y[1]).bit_count() if x[1] ^ y[1] >= 0 else ((x[1] ^ y[1]) % (1 << 64)).bit_count(), sum((a ^ b).bit_count() for a, b in zip(x[2], y[2], strict=True)), x[3] * y[3]) for x in rows for y in rows if x[0] < y[0]]
    for place, hist in ((2, distances.histogram(df)), (3, distances.histogram_of_sums(df))):
        want = {}
        for p in apart:
            want[p[place]] = want.get(p[place], 0) + p[4]
        same = sum(r[3] * (r[3] - 1) // 2 for r in rows)
        want[0] = want.get(0, 0) + same
        assert {r.distance: r.cnt for r in hist.collect() if r.cnt} == {k: v for k, v in want.items() if v}
    assert sorted(map(tuple, distances.near_sums(df, 5).collect())) == sorted((p[0], p[1], p[3]) for p in apart if p[3] <= 5)
    assert sorted(map(tuple, distances.hamming_pairs(df, 26, 64).collect())) == sorted((p[0], p[1], p[2]) for p in apart if p[2] <= 26)


def test_medians_by_rounds(spark):
    rng = np.random.default_rng(4)
    x = np.stack([rng.standard_normal(301), np.zeros(301), rng.integers(0, 3, 301), rng.exponential(1, 301) ** 6], axis=1)
    for rows, bins, few in ((x, 64, 2), (x[:300], 8, 4096), (x[:1], 8, 2)):
        values = spark.createDataFrame([(d, float(v)) for row in rows for d, v in enumerate(row)], "dim int, v double")
        got = {r["dim"]: r["median"] for r in hashing.medians(values, bins=bins, few=few).collect()}
        assert all(abs(got[d] - m) < 1e-12 for d, m in enumerate(np.median(rows, axis=0)))


def test_valley(spark):
    h = lambda xs: spark.createDataFrame(list(enumerate(xs)), "distance int, cnt long")
    assert threshold.valley(h([900, 800, 500, 200, 60, 10, 0, 10, 60, 200, 500, 800, 900, 800, 400])).first().threshold == 6
    assert threshold.valley(h([5, 7])).first().threshold == 0
    assert threshold.valley(h([1]).limit(0)).first().threshold == 0
    assert threshold.valley(h([1]).limit(0), empty=None).first().threshold is None
    assert threshold.percentile(h([5, 4, 3, 2, 1])).first().threshold == 0


def test_evaluation_contested(spark):
    c = spark.createDataFrame([("g1", "a", 3), ("g1", "b", 3), ("g2", "b", 3), ("g3", "c", 1), ("g3", "a", 2)], "group_id string, class string, n long")
    assert {r["class"]: r.group_id for r in evaluate.owners(c).collect()} == {"a": "g1", "b": "g2", "c": None}
    assert {r["class"]: r.group_id for r in evaluate.accuracy_owners(c).collect()} == {"a": "g1", "b": "g2", "c": None}
    assert evaluate.accuracy(c).first().accuracy == 50.0
    rng = random.Random(2)
    many = spark.createDataFrame([(f"g{g:02d}", f"c{k:02d}", rng.randint(1, 3)) for g in range(30) for k in rng.sample(range(20), 4)], "group_id string, class string, n long")
    assert sorted(map(tuple, evaluate.accuracy_owners(many, rest=0).collect()), key=repr) == sorted(map(tuple, evaluate.accuracy_owners(many).collect()), key=repr)
    assert evaluate.accuracy(c.limit(0)).first().accuracy == 0.0


def test_edits(spark):
    g = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "group_id string, id long")
    ids = spark.createDataFrame([(3,), (8,)], "id long")
    left, gone = curate.delete(g, ids)
    assert {r.id for r in left.collect()} == {1, 2} and {r.id for r in gone.collect()} == {3}
    kept, gone = curate.keep_one(g, "x", 7)
    assert {tuple(r) for r in kept.collect()} == {("x", 7), ("y", 3)} and {r.id for r in gone.collect()} == {1, 2}
    with pytest.raises(curate.UnknownGroup):
        curate.keep_one(g, "z", 1)
    assert curate.delete_group(g, "z")[0].count() == 3
    assert {tuple(r) for r in curate.move(g, ids, "n").collect()} == {("x", 1), ("x", 2), ("n", 3), ("n", 8)}


@pytest.mark.parametrize("method", METHODS)
def test_dedup_finds_copies(spark, method):
    x = np.random.default_rng(0).random((12, 16))
    x[7] = x[2]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    r = dedup(df, method, 16, threshold={"knn": 0.999}.get(method, 0), k=4)
    lead = {q.id: q.leader for q in r.groups.collect()}
    assert lead[7] == lead[2] == 2 and len(lead) == 12
    rep = report(r, spark.createDataFrame([(i, float(i)) for i in range(12)], "id long, total double"), df)
    assert rep.summary.first().total_items == 12 and rep.points.count() == 12


@pytest.mark.parametrize("method", METHODS[:4])
def test_dedup_finds_its_threshold(spark, method):
    """Two near rows among many far ones, without a threshold: it comes from the histogram, all pairs or a sample's."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((40, 16))
    x[30] = x[4]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    for sample in (None, 20) if method == "sign_lsh" else (20,) if method == "simhash" else (None,):
        r = dedup(df, method, 16, bits=64, sample=sample)
        lead = {q.id: q.leader for q in r.groups.collect()}
        assert lead[30] == lead[4] and len(lead) == 40 and isinstance(r.threshold, int) and len(set(lead.values())) > 3


def test_images(spark, tmp_path):
    red, dark = [[(200, 10, 10)] * 20] * 20, [[(0, 0, 0)] * 8] * 8
    for name, p in (("a_original.png", red), ("b_blur.PNG", dark)):
        (tmp_path / name).write_bytes(png(p))
    (tmp_path / "c.png").write_bytes(b"no image")
    (tmp_path / "d.txt").write_bytes(b"")
    df = src.images(spark, str(tmp_path))
    r = {x.filename: x for x in quality.score(df).collect()}
    assert set(r) == {"a_original.png", "b_blur.PNG", "c.png"}
    assert r["c.png"].total == 0 and r["c.png"].error and r["a_original.png"].filename_bonus == 30 and r["b_blur.PNG"].edge_integrity == 80
    v = extract(df, GridExtractor(4), size=32).collect()
    assert len(v) == 2 and all(abs(np.linalg.norm(x.features) - 1) < 1e-9 for x in v)
    assert src.files(spark, str(tmp_path)).count() == 3
    out = tmp_path / "z.zip"
    assert sinks.archive([str(tmp_path / "c.png"), str(tmp_path / "none.png")], str(out)) == 1


def test_bad_images_can_keep_their_row(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png([[(200, 10, 10)] * 20] * 20))
    (tmp_path / "c.png").write_bytes(b"no image")
    df = src.images(spark, str(tmp_path))
    assert {r.filename: len(r.features) for r in extract(df, GridExtractor(4), size=32, keep_bad=True).collect()} == {"a.png": 64, "c.png": 64}
    r = {x.filename: x for x in quality.sharpness_and_saturation(df).collect()}
    assert (r["c.png"].sharpness, r["c.png"].saturation) == (0, 0) and r["a.png"].sharpness == 0 and abs(r["a.png"].saturation - 190 * 255 / 200) < 1e-9
    assert quality.rounded(spark.createDataFrame([(1.005, 2.675, "x")], "a double, b double, c string")).first().c == "x"


def test_an_extractor_loads_its_weights_in_each_worker(spark, tmp_path):
    """A network of one layer, stored and read by ``load``: the features are those of its weights."""
    weights = np.random.default_rng(6).standard_normal((16 * 16 * 3, 5))
    np.save(tmp_path / "w.npy", weights)

    class Layer(GridExtractor):
        dim = 5

        def __init__(self, path):
            self.path = path

        def load(self):
            self.weights = np.load(self.path)

        def embed(self, batch):
            return np.maximum(0, batch.reshape(len(batch), -1) @ self.weights)

    (tmp_path / "a.png").write_bytes(png([[(200, 10, 10)] * 16] * 16))
    one = lambda x, rng: [x]
    got = extract(src.images(spark, str(tmp_path)), Layer(str(tmp_path / "w.npy")), variants=one, size=16, unit=False).first().features
    x = pixels.channel_normalize(pixels.resize(pixels.grayscale(np.full((16, 16, 3), (200, 10, 10)) / 255.0), 16, 16))
    assert np.allclose(got, np.maximum(0, x.reshape(-1) @ weights))


def test_sessions_and_copies(spark, tmp_path):
    up = spark.createDataFrame([("../a/b.png", b"1"), (" ", b"2"), ("c.png", b"3")], "name string, content binary")
    kept = src.store(up, str(tmp_path / "s"))
    assert {r.filename: bytes(r.content) for r in kept.collect()} == {"_a_b.png": b"1", "c.png": b"3"} and len(kept.first().session_id) == 8
    with pytest.raises(curate.UnknownSession):
        src.session_files(spark, str(tmp_path / "s"), "none")
    with pytest.raises(ValueError):
        src.store(up.limit(0), str(tmp_path / "s"))
    (tmp_path / "in").mkdir()
    for name in ("x.png", "y.png"):
        (tmp_path / "in" / name).write_bytes(name.encode())
    groups = spark.createDataFrame([("group_000", "x.png"), ("group_000", "y.png"), ("group_001", "gone.png")], "group_id string, filename string")
    files = spark.createDataFrame([(n, f"{tmp_path}/in/{n}") for n in ("x.png", "y.png", "gone.png")], "filename string, path string")
    done = sinks.copy_groups(groups, files, f"{tmp_path}/out")
    assert {(r.filename, r.copied) for r in done.collect()} == {("x.png", True), ("y.png", True), ("gone.png", False)}
    assert sorted(p.name for p in (tmp_path / "out" / "group_000").iterdir()) == ["x.png", "y.png"] and (tmp_path / "out" / "group_000" / "x.png").read_bytes() == b"x.png"


def test_report_in_words(spark):
    x = np.random.default_rng(0).random((6, 8))
    x[3] = x[1]
    r = dedup(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>"), "sign_lsh", 8, threshold=0, planes=64)
    said = [q.line for q in lines(r, correct=spark.createDataFrame([(50.0,)], "accuracy double")).collect()]
    assert said[0] == "items: 6" and "accuracy: 50.00 %" in said and any(s.startswith("clustering: ") for s in said)


def test_valley_of_the_mixture_is_one(spark):
    from twinsieve import queries

    d = "/root/testdata/sf0.001"
    found = {r.distance for r in threshold.minima(queries.threshold_valley_smoothed(spark, d)).collect()}
    assert queries.threshold_valley_mixture(spark, d).first().threshold in found


def test_image_quality_scores_every_row(spark, tmp_path):
    from twinsieve.queries import image_quality

    d = "/root/testdata/sf0.001"
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    got = {r.filename: r for r in image_quality(spark, d).collect()}
    assert len(got) == e.count() > 4
    for r in e.orderBy("vec_id").limit(3).collect():
        x = [min(255, max(0, int(128 + 400 * v))) for v in r.embedding]
        (tmp_path / f"c{r.label}_{r.vec_id}.png").write_bytes(png([[(x[(i * j) % 64], x[(i + j) % 64], x[(i ^ j) % 64]) for j in range(32)] for i in range(32)]))
    read = quality.score(src.images(spark, str(tmp_path))).collect()
    assert len(read) == 3 and all(got[r.filename] == r for r in read)


def test_variants():
    x = np.random.default_rng(0).random((16, 16, 3))
    for make in (pixels.photo_set, pixels.batch_set):
        v = make(x, np.random.default_rng(1))
        assert len(v) == 25 and all(i.shape == x.shape for i in v)
    assert pixels.random_transform(x, np.random.default_rng(1), 16).shape == x.shape
    assert pixels.preprocess(x, np.random.default_rng(1), 16).shape == x.shape


def test_storage(spark):
    from twinsieve.storage import clean, settle, shared_dir

    df = settle(spark.range(3), "three")
    assert df.count() == 3 and spark.sparkContext.applicationId in df.inputFiles()[0] or shared_dir(spark).startswith("file:/")
    again = settle(spark.range(2), "two")
    assert again.count() == 2

    class Conf:
        def get(self, name):
            return None

    class Context:
        applicationId, master, getConf = "x", "spark://host:7077", lambda self: Conf()

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        shared_dir(Session())
    assert callable(clean)
