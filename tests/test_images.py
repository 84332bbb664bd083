import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from bandloom.operators import curves, features, iterate, linear, pixels as px, render, score, spatial, stats
from bandloom.plans import core, image_queries as q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings samples spectra spectra_raw usgs_samples usgs_spectrometer".split()


def _plain(rows):
    return sorted((tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted({**q.ORACLES, **core.ORACLES}))
def test_same_rows_as_sql(spark, sf, name):
    if name.startswith("window"):
        sf = sf.replace("0.001", "0.01")  # the smallest image is lower than the windows
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = {**q.QUERIES, **core.QUERIES}[name](spark, sf)
    cols = sorted(df.columns)
    want = con.sql({**q.ORACLES, **core.ORACLES}[name])
    assert sorted(want.columns) == cols
    assert _plain(map(tuple, df.select(*cols).collect())) == _plain(want.project(", ".join(cols)).fetchall())


def image(spark, x):
    r, c, _ = x.shape
    return spark.createDataFrame([(i, j, x[i, j].tolist()) for i in range(r) for j in range(c)], "row int, col int, spectrum array<double>")


@pytest.fixture(scope="module")
def cube():
    return np.random.default_rng(1).random((8, 9, 4))


def test_statistics(spark, cube):
    s = stats.calc_stats(image(spark, cube).repartition(3))
    flat = cube.reshape(-1, 4)
    assert np.allclose(s.mean, flat.mean(0)) and np.allclose(s.cov, np.cov(flat.T)) and s.nsamples == 72
    assert np.allclose(s.sqrt_cov @ s.sqrt_cov, s.cov) and np.allclose(s.sqrt_inv_cov @ s.sqrt_inv_cov, s.inv_cov)
    white = stats.calc_stats(s.whitening().apply(image(spark, cube)))
    assert np.allclose(white.cov, np.eye(4), atol=1e-8)
    with pytest.raises(ValueError):
        stats.calc_stats(image(spark, np.full((2, 2, 2), np.nan)))
    with pytest.raises(ValueError):
        stats.calc_stats(image(spark, cube).limit(0))


def test_detectors(spark, cube):
    s = stats.calc_stats(image(spark, cube))
    t = cube[2, 3]
    two = spark.createDataFrame([(0, s.mean.tolist()), (1, t.tolist()), (2, None)], "id int, spectrum array<double>")
    mf = {r["id"]: r["mf"] for r in score.matched_filter(two, t, s).collect()}
    assert abs(mf[0]) < 1e-9 and abs(mf[1] - 1) < 1e-9 and mf[2] is None
    a = {r["id"]: r["ace"] for r in score.ace(two, [t, cube[:2, 0]], s).collect()}
    assert a[0] == [0.0, 0.0] and abs(a[1][0] - 1) < 1e-9


def test_transforms(spark, cube):
    x = np.random.default_rng(2).random(4)
    a, b = linear.LinearTransform(np.ones((2, 4)), pre=x, post=1.0), linear.LinearTransform(3.0, post=np.arange(4.0))
    assert np.allclose(a.chain(b)(x), a(b(x))) and np.allclose(b.chain(linear.LinearTransform(2.0))(x), b(2 * x))
    s = stats.calc_stats(image(spark, cube))
    pc = linear.principal_components(s)
    assert np.all(np.diff(pc.eigenvalues) <= 0) and np.allclose(pc.eigenvectors.T @ pc.eigenvectors, np.eye(4))
    assert len(pc.reduce(fraction=1.0).eigenvalues) == 4
    mnf = linear.MinimumNoiseFraction(s, stats.noise_from_diffs(image(spark, cube)))
    assert np.allclose(mnf.denoising(num=4)(cube[0]), cube[0])
    o = linear.orthogonalize(np.random.default_rng(3).random((3, 6)))
    assert np.allclose(o @ o.T, np.eye(3))


def test_discriminant_whitens(spark, cube):
    df = image(spark, cube).withColumn("class_id", (F.col("col") % 3 + 1).cast("int"))
    c = stats.class_stats(df, "class_id")
    lda = linear.linear_discriminant(c)
    assert len(lda.eigenvalues) == 2 and np.allclose(np.diag(lda.eigenvectors.T @ lda.cov_w @ lda.eigenvectors), 1)
    got = score.GaussianClassifier(c, min_samples=2)
    assert all(got.best(s.mean[None])[0] in c for s in c.values())
    assert set(stats.load_training(spark, _saved(spark, c))) == set(c)


def _saved(spark, c):
    import tempfile

    path = tempfile.mkdtemp() + "/classes"
    stats.save_training(c, spark, path)
    return path


def test_smacc_golden(spark):
    h = [[1, 1, 0], [0, 1, 1], [1, 0, 0], [0.5, 0.5, 0]]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(h)], "id long, spectrum array<double>")
    keys, out = iterate.smacc(df, "id")
    rows = {r["key"]: r for r in out.collect()}
    s = np.array([h[k] for k in keys])
    for i, r in enumerate(h):
        assert np.allclose(np.array(rows[i]["abundances"]) @ s + rows[i]["residual"], r, atol=1e-9)
    assert sorted(keys) == [0, 1, 2]


def test_purity_goes_on(spark, cube):
    df = image(spark, cube)
    a = iterate.purity(df, 20, seed=1)
    both = iterate.purity(df, 20, seed=2, start=a)
    assert a.agg(F.sum("purity")).first()[0] == 40 and both.agg(F.sum("purity")).first()[0] == 80


def test_kmeans_and_perceptron(spark):
    x = np.concatenate([np.zeros((5, 2)), np.ones((5, 2)) * 9]).reshape(2, 5, 2)
    out, centers = iterate.kmeans(image(spark, x), 2)
    assert np.allclose(sorted(centers[:, 0]), [0, 9]) and out.groupBy("cluster").count().count() == 2
    net = iterate.Perceptron([2, 3, 1], seed=4)
    assert net.train([[0, 0], [0, 1], [1, 0], [1, 1]], [0, 1, 1, 0], rate=0.5, momentum=0.9, max_iterations=8000) == 100.0


def test_window_bounds():
    assert [int(v) for v in (*spatial.window_bounds(90, 3, 30), *spatial.window_bounds(90, 7, 40))] == [29, 32, 37, 44]
    assert [int(v) for v in (*spatial.window_bounds(90, 3, 0), *spatial.window_bounds(90, 7, 2))] == [0, 3, 0, 7]
    assert [int(v) for v in (*spatial.window_bounds(90, 3, 0, True), *spatial.window_bounds(90, 7, 2, True))] == [0, 2, 0, 6]


def test_windowed_ace_bounds(spark, cube):
    got = spatial.windowed(image(spark, cube), "ace", 1, 5, (8, 9), target=cube[0, 0])
    assert got.count() == 72 and got.where("score < 0 or score > 1").count() == 0


@pytest.mark.parametrize(
    ("y", "want"),
    [
        ([0, 1, 0.5, 0.6, 5.9, 6, 0, 0, 0, 20], [0, 1, 4, 5, 9]),  # a stretch between kept maxima gets a hull of its own
        ([0, 2, 0, 0, 0, 20], [0, 1, 5]),  # five bands apart are enough
        ([20, 0, 0, 0, 2, 0], [0, 4, 5]),  # from the lower end on
        ([0, 2, 0, 0, 20], [0, 4]),  # four aren't
        ([0, 1, 1, 1, 0.5, 0.2, 9], [0, 1, 6]),  # of a flat maximum the first
        ([0, 0.9, 1, 0, 0, 0, 0, 9], [0, 2, 7]),  # none two bands before a kept maximum
        ([1, 1, 1, 1, 1, 1], [0, 5]),
    ],
)
def test_segmented_continuum(y, want):
    assert curves.points(np.array(y, float), range(len(y)), "segmented") == want


def test_local_windows_in_many_bands(spark):
    """Scores of all pixels at once against one pixel at a time, with missing pixels."""
    x = np.random.default_rng(5).random((14, 15, 3))
    gone = {(3, 4), (7, 7)}
    rows = [(i, j, x[i, j].tolist()) for i in range(14) for j in range(15) if (i, j) not in gone]
    df = spark.createDataFrame(rows, "row int, col int, spectrum array<double>")
    t = x[1, 1] + 0.2
    for detector in ("rx", "mf", "ace"):
        got = {(r["row"], r["col"]): r["score"] for r in spatial.windowed(df, detector, 3, 7, (14, 15), target=t).collect()}
        assert len(got) == len(rows)
        for i, j in [(0, 0), (5, 5), (13, 14), (8, 7)]:
            a, b = (int(np.clip(v - 3, 0, n - 7)) for v, n in ((i, 14), (j, 15)))
            p, q = (int(np.clip(v - 1, 0, n - 3)) for v, n in ((i, 14), (j, 15)))
            w = np.array([x[k, m] for k in range(a, a + 7) for m in range(b, b + 7) if (k, m) not in gone and not (p <= k < p + 3 and q <= m < q + 3)])
            mean, cov = w.mean(0), np.cov(w.T)
            inv = np.linalg.inv(cov)
            want = {"rx": score.rx_scores(x[i, j][None], mean, inv), "mf": score.mf_scores(x[i, j][None], mean, inv, t), "ace": score.ace_scores(x[i, j][None], mean, stats.matrix_sqrt(cov, inverse=True), t)}[detector][0]
            assert abs(got[i, j] - want) < 1e-8
    with pytest.raises(ValueError):
        spatial.windowed(df, "rx", 7, 7, (14, 15))


def test_detector_objects(spark, cube):
    df, flat = image(spark, cube), cube.reshape(-1, 4)
    b = stats.calc_stats(df)
    for kind, want in (("rx", score.rx_scores(flat, b.mean, b.inv_cov)), ("mf", score.mf_scores(flat, b.mean, b.inv_cov, cube[1, 1])), ("ace", score.ace_scores(flat, b.mean, b.sqrt_inv_cov, cube[1, 1]))):
        d = score.Detector(kind, cube[1, 1])
        got = {(r["row"], r["col"]): r["score"] for r in d(df).collect()}
        assert np.allclose([got[i, j] for i in range(8) for j in range(9)], want)
        d.set_background(b)
        assert np.allclose(d(flat), want)
    d = score.Detector("ace", [cube[0, 0], cube[:2, 1]], b)
    assert d(flat).shape == (72, 2) and len(d(df).first()["score"]) == 2
    d.set_target(cube[2, 2])
    assert d(flat).shape == (72,)
    with pytest.raises(ValueError):
        score.Detector("mf", None, b)(flat)
    with pytest.raises(ValueError):
        score.Detector("x")


def test_training_sets_and_own_classifiers(spark, cube):
    df = image(spark, cube).withColumn("class_id", (F.col("col") % 3).cast("int"))
    t = stats.TrainingSet(df)
    assert not t.stats_valid and len(t) == 2 and sorted(t) == [1, 2] and t.stats_valid
    two = linear.LinearTransform(np.eye(4)[:2] * 2, post=1.0)
    moved = t.transform(two)
    again = stats.class_stats(moved.samples, "class_id")
    assert all(np.allclose(moved[c].mean, again[c].mean) and np.allclose(moved[c].cov, again[c].cov) for c in (1, 2))
    more = t.add(7, df.where("class_id = 0"))
    assert len(more) == 3 and more[7].nsamples == 24 and more.pixels(7).count() == 24
    with pytest.raises(ValueError):
        t.add(1, df)

    class First(score.Classifier):
        ids = [4, 9]

        def scores(self, x):
            return np.column_stack([x[:, 0], x[:, 1]])

    got = {(r["row"], r["col"]): r["predicted"] for r in First().classify(df).collect()}
    assert all(got[i, j] == (4 if cube[i, j, 0] >= cube[i, j, 1] else 9) for i in range(8) for j in range(9))
    assert np.allclose(two(t[1]).mean, moved[1].mean) and two(df).count() == 72


def test_roots_arrays_and_values(spark, cube):
    m = np.array([[2.0, 1.0], [0.5, 3.0]])
    r = stats.matrix_sqrt(m, symmetric=False)
    assert np.allclose(r @ r, m) and np.allclose(stats.matrix_sqrt(m, inverse=True, symmetric=False) @ r, np.eye(2))
    s = np.array([[2.0, 1.0], [1.0, 2.0]])
    assert np.allclose(stats.matrix_sqrt(None, eigs=np.linalg.eigh(s)), stats.matrix_sqrt(s))
    df = image(spark, cube)
    assert px.shape(df) == (8, 9, 4) and np.allclose(px.to_array(df), cube) and px.shape(df.limit(0)) == (0, 0, 0)
    assert px.datum(df, 2, 3, -1) == pytest.approx(cube[2, 3, 3]) and px.datum(df, 99, 0, 0) is None
    with pytest.raises(ValueError):
        px.to_array(df, most=10)
    assert curves.normal(0, 1, 0) == pytest.approx(0.3989422804)


def test_pictures(spark, tmp_path):
    import struct
    import zlib

    rgb = spark.createDataFrame([(0, 0, 1.0, 0.5, 0.0), (1, 2, 0.0, 0.0, 1.0)], "row int, col int, r double, g double, b double")
    want = np.zeros((2, 3, 3), np.uint8)
    want[0, 0], want[1, 2] = (255, 127, 0), (0, 0, 255)
    assert np.array_equal(render.make_picture(rgb), want)
    render.save_rgb(str(tmp_path / "a.png"), rgb)
    raw = (tmp_path / "a.png").read_bytes()
    assert raw[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", raw[16:24]) == (3, 2)
    at = raw.index(b"IDAT")
    data = zlib.decompress(raw[at + 4 : at + 4 + struct.unpack(">I", raw[at - 4 : at])[0]])
    assert np.array_equal(np.frombuffer(data, np.uint8).reshape(2, 10)[:, 1:].reshape(2, 3, 3), want)
    tiles = render.save_tiles(str(tmp_path / "t"), rgb, tile=2).collect()
    assert sorted((r["tile_row"], r["tile_col"]) for r in tiles) == [(0, 0), (0, 1)] and len(list((tmp_path / "t").iterdir())) == 2
    assert render.make_picture(rgb.limit(0)).shape == (0, 0, 3)
    assert render.default_scale()(24) == (0, 255, 0) and render.default_scale()(25) == (255, 0, 0) and render.default_scale(11)(15) == (0, 127, 127) and len(render.default_scale(12).table) == 12
    with pytest.raises(ValueError):
        render.default_scale(3)


def test_feature_points(spark):
    assert features.mirrored_octants([0, 1, 2, 3, 4, 5]) == [(0, 1, 2), (3, 1, 2), (3, 4, 2), (0, 4, 2), (0, 1, 5), (3, 1, 5), (3, 4, 5), (0, 4, 5)]
    assert features.place(17, 5) == (3, 2)
    df = spark.createDataFrame([(0, 0, [0.0, 5.0]), (0, 1, [2.0, 5.0]), (1, 0, [4.0, 5.0]), (1, 1, None)], "row int, col int, spectrum array<double>")
    at = features.points(df, spark.createDataFrame([(0, 1, 2)], "row int, col int, class_id int"), [0, 1])
    assert {(r["row"], r["col"]): (list(r["point"]), r["class_id"], r["r"], r["g"]) for r in at.collect()} == {(0, 0): ([0.0, 0.0], 0, 255, 255), (0, 1): ([0.5, 0.0], 2, 0, 255), (1, 0): ([1.0, 0.0], 0, 255, 255)}
    done, n = features.reassign(at, {0: (0.4, 1.0)}, 2)
    assert n == 1 and {(r["row"], r["col"]): r["class_id"] for r in done.collect()} == {(0, 0): 0, (0, 1): 2, (1, 0): 2}


def test_matching_class_ids(spark):
    a = spark.createDataFrame([(0, i, v) for i, v in enumerate([0, 0, 1, 1, 1, 2, 2, 9])], "row int, col int, class_id int")
    b = spark.createDataFrame([(0, i, v) for i, v in enumerate([0, 3, 5, 5, 3, 3, 3, 0])], "row int, col int, class_id int")
    assert px.match_classes(a, b, [0, 9]) == {0: 0, 9: 9, 1: 5, 2: 3}
    assert px.match_classes(a, b, 0) == {0: 0, 1: 5, 2: 3, 9: 1}


def test_continuum(spark):
    y = np.array([1.0, 3.0, 2.0, 2.5, 4.0, 1.0])
    assert curves.points(y, range(6)) == [0, 1, 4, 5]
    df = spark.createDataFrame([(y.tolist(),), (None,)], "spectrum array<double>")
    got = [r[0] for r in curves.remove_continuum(df, range(6)).select("removed").collect()]
    assert max(got[0]) == pytest.approx(1.0) and got[0][1] == pytest.approx(1.0) and got[1] is None


def test_resampling():
    m = curves.resampling_matrix(np.arange(10.0), [3.0, 50.0])
    assert m[0].sum() == pytest.approx(1) and math.isnan(m[1, 0])


def test_class_matching_and_rendering(spark):
    a = spark.createDataFrame([(0, 0, 1), (0, 1, 1), (0, 2, 2), (0, 3, 0)], "row int, col int, class_id int")
    b = spark.createDataFrame([(0, 0, 7), (0, 1, 7), (0, 2, 7), (0, 3, 0)], "row int, col int, class_id int")
    assert px.match_classes(a, b) == {0: 0, 1: 7, 2: 1}
    with pytest.raises(ValueError):
        px.recode(a, {1: 2})
    _, n = px.label_region(a, (0, 1), (0, 2), 5)
    assert n == 2
    scale = render.ColorScale([0, 1], [(0, 0, 0), (255, 255, 255)], 3)
    assert scale(-1) == (0, 0, 0) and scale(1) == (255, 255, 255)
    one = spark.createDataFrame([(0, 0, [1.0]), (0, 1, [1.0])], "row int, col int, spectrum array<double>")
    assert [r["r"] for r in render.get_rgb(one, [0]).collect()] == [0.0, 0.0]
