"""Queries of the image operators on the driver's tables, each with the SQL that derives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from bandloom.common import maybe_broadcast, one_per_key, table
from bandloom.functions import arrays
from bandloom.operators import curves, features, iterate, linear, pixels as px, render, score, spatial, stats, units
from bandloom.sources import signatures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def cube(spark: SparkSession, d: str) -> DataFrame:
    """embeddings as an image 25 wide with classes from 1 on."""
    return px.grid(table(spark, d, "embeddings"), "vec_id", 25, F.col("embedding"), F.col("label") + 1)


def parts(spark: SparkSession, d: str) -> DataFrame:
    """part as an image of two bands, 50 wide, with five classes by size."""
    return px.grid(table(spark, d, "part"), "p_partkey", 50, F.array(F.col("p_size").cast("double"), F.col("p_retailprice")), F.floor((F.col("p_size") - 1) / 10) + 1)


def lines(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as a bag of spectra of four bands, with a class by return flag."""
    flag = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)
    return table(spark, d, "lineitem").select(F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("spectrum"), flag.alias("class_id"))


def _shape(p: DataFrame) -> tuple[int, int]:
    r = p.agg(F.max("row"), F.max("col")).first()
    return r[0] + 1, r[1] + 1


def _r(c, n: int = 6):  # noqa: ANN001, ANN202
    return F.round(c, n) + 0.0


_CUBE = "cube as (select vec_id, cast(vec_id // 25 as int) as row, cast(vec_id % 25 as int) as col, cast(embedding as double[]) as s, label + 1 as class_id from embeddings)"
_LONG = _CUBE + ", long as (select row, col, class_id, unnest(s) as v, generate_subscripts(s, 1) - 1 as band from cube)"
_MEANS = _LONG + ", m as (select class_id, band, avg(v) as v from long group by all), means as (select class_id as member, list(v order by band) as m from m group by all)"
_PART = "p as (select p_partkey, cast(p_partkey // 50 as int) as row, cast(p_partkey % 50 as int) as col, cast(p_size as double) as x, p_retailprice as y, cast((p_size - 1) // 10 + 1 as int) as class_id from part)"
_BG = _PART + ", b as (select avg(x) as mx, avg(y) as my, var_samp(x) as a, covar_samp(x, y) as c, var_samp(y) as d, count(*) as n from p), inv as (select *, d / (a * d - c * c) as ia, -c / (a * d - c * c) as ic, a / (a * d - c * c) as id from b)"
_CLS = _PART + ", cl as (select class_id, avg(x) as mx, avg(y) as my, var_samp(x) as a, covar_samp(x, y) as c, var_samp(y) as d, count(*) as n from p group by class_id)"


def _means(c: DataFrame) -> DataFrame:
    long = c.select("class_id", F.posexplode("spectrum").alias("band", "v")).groupBy("class_id", "band").agg(F.avg("v").alias("v"))
    return long.groupBy("class_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "v"))), lambda x: x["v"]).alias("m")).withColumnRenamed("class_id", "member")


def _mean_matrix(c: DataFrame) -> tuple[list[int], np.ndarray]:
    rows = _means(c).orderBy("member").collect()  # a row a class
    return [r["member"] for r in rows], np.array([r["m"] for r in rows])


@_query(f"""with {_MEANS}, a as (select vec_id, class_id, member, acos(greatest(-1, least(1, list_cosine_similarity(s, m)))) as t from cube, means),
best as (select vec_id, any_value(class_id) as actual, min_by(member, (round(t, 9), member)) as predicted from a group by vec_id)
select cast(actual as int) as actual, cast(predicted as int) as predicted, cast(count(*) as bigint) as n from best group by all""")
def sam_confusion(spark: SparkSession, d: str) -> DataFrame:
    """Every pixel to the class mean at the smallest angle, as a confusion table."""
    c = cube(spark, d)
    ids, m = _mean_matrix(c)
    angles = score.angles(c, m)
    nearest = F.array_min(F.zip_with("angles", F.array(*[F.lit(i) for i in ids]), lambda a, i: F.struct(F.round(a, 9).alias("a"), i.alias("i"))))
    return angles.select(F.col("class_id").alias("actual"), nearest["i"].alias("predicted")).groupBy("actual", "predicted").agg(F.count("*").alias("n"))


@_query(f"with {_MEANS} select row, col, cast(member as int) as member, round(acos(greatest(-1, least(1, list_cosine_similarity(s, m)))), 6) as angle from cube, means")
def member_angles(spark: SparkSession, d: str) -> DataFrame:
    c = cube(spark, d)
    ids, m = _mean_matrix(c)
    out = score.angles(c, m).select("row", "col", F.posexplode("angles").alias("i", "angle"))
    return out.select("row", "col", F.get(F.array(*[F.lit(i) for i in ids]), F.col("i")).alias("member"), _r("angle").alias("angle"))


@_query(f"""with {_MEANS}, cx as (select row, col, list_transform(s, lambda v: v - list_avg(s)) as s from cube), cm as (select member, list_transform(m, lambda v: v - list_avg(m)) as m from means)
select row, col, cast(member as int) as member, round(1 - acos(greatest(-1, least(1, list_cosine_similarity(s, m)))) / (pi() / 2), 6) as score from cx, cm""")
def msam(spark: SparkSession, d: str) -> DataFrame:
    c = cube(spark, d)
    ids, m = _mean_matrix(c)
    out = score.msam(c, m).select("row", "col", F.posexplode("scores").alias("i", "score"))
    return out.select("row", "col", F.get(F.array(*[F.lit(i) for i in ids]), F.col("i")).alias("member"), _r("score").alias("score"))


def _cov_long(spark: SparkSession, groups: dict[int, stats.GaussianStats]) -> DataFrame:
    rows = [(int(c), i, j, float(s.cov[i, j])) for c, s in groups.items() for i in range(len(s.mean)) for j in range(len(s.mean))]
    return spark.createDataFrame(rows, "class_id int, i int, j int, cov double")


@_query(f"with {_LONG} select cast(a.band as int) as i, cast(b.band as int) as j, round(covar_samp(a.v, b.v), 8) + 0.0 as cov from long a join long b using (row, col) group by all")
def covariance(spark: SparkSession, d: str) -> DataFrame:
    return _cov_long(spark, {0: stats.calc_stats(cube(spark, d))}).select("i", "j", _r("cov", 8).alias("cov"))


@_query(f"with {_LONG} select cast(band as int) as band, round(avg(v), 8) + 0.0 as mean, cast(count(*) as bigint) as n from long group by band")
def mean_spectrum(spark: SparkSession, d: str) -> DataFrame:
    s = stats.calc_stats(cube(spark, d))
    return spark.createDataFrame([(i, float(v), s.nsamples) for i, v in enumerate(s.mean)], "band int, mean double, n long").select("band", _r("mean", 8).alias("mean"), "n")


_LINES = "l as (select case l_returnflag when 'A' then 1 when 'N' then 2 else 3 end as class_id, [l_quantity, l_extendedprice, l_discount, l_tax] as s, row_number() over () as id from lineitem), ll as (select id, class_id, unnest(s) as v, generate_subscripts(s, 1) - 1 as band from l), cc as (select a.class_id, cast(a.band as int) as i, cast(b.band as int) as j, covar_samp(a.v, b.v) as cov, count(*) as n from ll a join ll b on a.id = b.id group by all)"


@_query(f"with {_LINES} select cast(class_id as int) as class_id, i, j, round(cov, 4) + 0.0 as cov from cc")
def class_covariance(spark: SparkSession, d: str) -> DataFrame:
    return _cov_long(spark, stats.class_stats(lines(spark, d), "class_id")).select("class_id", "i", "j", _r("cov", 4).alias("cov"))


@_query(f"with {_LINES} select i, j, round(sum((n - 1) * cov) / (sum(n) - 1), 4) + 0.0 as cov from cc group by i, j")
def averaged_covariance(spark: SparkSession, d: str) -> DataFrame:
    c = stats.cov_avg(stats.class_stats(lines(spark, d), "class_id"))
    return _cov_long(spark, {0: stats.GaussianStats(np.zeros(len(c)), c, 1)}).select("i", "j", _r("cov", 4).alias("cov"))


@_query(f"with {_BG} select row, col, round((x - mx) * (x - mx) * ia + 2 * (x - mx) * (y - my) * ic + (y - my) * (y - my) * id, 6) + 0.0 as rx from p, inv")
def rx(spark: SparkSession, d: str) -> DataFrame:
    p = parts(spark, d)
    return score.rx(p, stats.calc_stats(p)).select("row", "col", _r("rx").alias("rx"))


_TARGET = "t as (select *, 10.0 - mx as tx, 1500.0 - my as ty from inv), w as (select *, tx * tx * ia + 2 * tx * ty * ic + ty * ty * id as tt from t)"


@_query(f"with {_BG}, {_TARGET} select row, col, round(((x - mx) * (tx * ia + ty * ic) + (y - my) * (tx * ic + ty * id)) / tt, 6) + 0.0 as mf from p, w")
def matched_filter(spark: SparkSession, d: str) -> DataFrame:
    p = parts(spark, d)
    return score.matched_filter(p, np.array([10.0, 1500.0]), stats.calc_stats(p)).select("row", "col", _r("mf").alias("mf"))


@_query(f"""with {_BG}, {_TARGET}, q as (select row, col, (x - mx) * (tx * ia + ty * ic) + (y - my) * (tx * ic + ty * id) as xt, (x - mx) * (x - mx) * ia + 2 * (x - mx) * (y - my) * ic + (y - my) * (y - my) * id as xx, tt from p, w)
select row, col, round(least(1, greatest(0, xt * xt / (tt * xx))), 6) + 0.0 as ace from q""")
def ace(spark: SparkSession, d: str) -> DataFrame:
    p = parts(spark, d)
    return score.ace(p, np.array([10.0, 1500.0]), stats.calc_stats(p)).select("row", "col", _r("ace").alias("ace"))


@_query(f"""with {_CLS}, g as (select p.row, p.col, cl.class_id as k, -0.5 * ln(a * d - c * c) - 0.5 * ((x - mx) * (x - mx) * d - 2 * (x - mx) * (y - my) * c + (y - my) * (y - my) * a) / (a * d - c * c) as s from p, cl)
select row, col, max_by(k, (s, -k)) as predicted from g group by row, col""")
def gaussian_classifier(spark: SparkSession, d: str) -> DataFrame:
    p = parts(spark, d)
    return score.GaussianClassifier(stats.class_stats(p, "class_id")).classify(p).select("row", "col", "predicted")


@_query(f"""with {_CLS}, pool as (select sum(n * a) / sum(n) as a, sum(n * c) / sum(n) as c, sum(n * d) / sum(n) as d from cl),
g as (select p.row, p.col, cl.class_id as k, ((x - mx) * (x - mx) * pool.d - 2 * (x - mx) * (y - my) * pool.c + (y - my) * (y - my) * pool.a) / (pool.a * pool.d - pool.c * pool.c) as s from p, cl, pool)
select row, col, min_by(k, (s, k)) as predicted from g group by row, col""")
def mahalanobis_classifier(spark: SparkSession, d: str) -> DataFrame:
    p = parts(spark, d)
    return score.MahalanobisClassifier(stats.class_stats(p, "class_id")).classify(p).select("row", "col", "predicted")


@_query(f"""with {_CLS}, q as (select u.class_id as a, v.class_id as b, v.mx - u.mx as ex, v.my - u.my as ey, (u.a + v.a) / 2 as ca, (u.c + v.c) / 2 as cc, (u.d + v.d) / 2 as cd, u.a * u.d - u.c * u.c as da, v.a * v.d - v.c * v.c as db from cl u join cl v on u.class_id < v.class_id)
select a, b, round((ex * ex * cd - 2 * ex * ey * cc + ey * ey * ca) / (ca * cd - cc * cc) / 8 + 0.5 * (ln(ca * cd - cc * cc) - 0.5 * ln(da) - 0.5 * ln(db)), 6) as distance from q""")
def bhattacharyya(spark: SparkSession, d: str) -> DataFrame:
    s = stats.class_stats(parts(spark, d), "class_id")
    rows = [(a, b, stats.bhattacharyya(s[a], s[b])) for a in s for b in s if a < b]
    return spark.createDataFrame(rows, "a int, b int, distance double").select("a", "b", _r("distance").alias("distance"))


@_query(f"""with {_BG}, e as (select (a + d) / 2 as h, sqrt((a - d) * (a - d) / 4 + c * c) as r, a, c, d from b)
select 0 as component, round(h + r, 3) as eigenvalue from e union all select 1, round(h - r, 3) from e""")
def principal_components(spark: SparkSession, d: str) -> DataFrame:
    pc = linear.principal_components(stats.calc_stats(parts(spark, d)))
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(pc.eigenvalues)], "component int, eigenvalue double").select("component", _r("eigenvalue", 3).alias("eigenvalue"))


@_query(f"with {_PART} select row, col, round((x * 2000.0 - y * 5.0) / (40.0 * 2000.0 - 900.0 * 5.0), 6) + 0.0 as a, round((y * 40.0 - x * 900.0) / (40.0 * 2000.0 - 900.0 * 5.0), 6) + 0.0 as b from p")
def unmix(spark: SparkSession, d: str) -> DataFrame:
    """Abundances of two members in two bands, which solve the pixel exactly."""
    t = linear.unmixing(np.array([[40.0, 900.0], [5.0, 2000.0]])).apply(parts(spark, d))
    return t.select("row", "col", _r(F.get("spectrum", F.lit(0))).alias("a"), _r(F.get("spectrum", F.lit(1))).alias("b"))


@_query(f"with {_PART}, b as (select avg(x) as mx, avg(y) as my from p) select row, col, round(2 * (x - mx) - 0.5 * (y - my) + 1, 5) + 0.0 as v from p, b")
def chained_transform(spark: SparkSession, d: str) -> DataFrame:
    """Two linear transforms fused to one matrix."""
    p = parts(spark, d)
    center = linear.LinearTransform(1.0, pre=-stats.calc_stats(p).mean)
    t = linear.LinearTransform(np.array([[2.0, -0.5]]), post=np.array([1.0])).chain(center)
    return t.apply(p).select("row", "col", _r(F.get("spectrum", F.lit(0)), 5).alias("v"))


@_query(f"with {_CUBE} select row, col, round(coalesce((s[50] - s[20]) / nullif(s[50] + s[20] + 2, 0), 'nan'::double), 6) + 0.0 as ndvi from cube")
def ndvi(spark: SparkSession, d: str) -> DataFrame:
    c = cube(spark, d).withColumn("spectrum", F.transform("spectrum", lambda v: v + 1))
    return px.ndvi(c, 19, 49).select("row", "col", _r("ndvi").alias("ndvi"))


@_query(f"with {_CUBE} select row, col, round(s[6], 6) as b0, round(s[2], 6) as b1, round(s[6], 6) as b2, round(s[64], 6) as b3 from cube")
def band_list(spark: SparkSession, d: str) -> DataFrame:
    """Bands in any order, with repeats and from the end."""
    c = px.select_bands(cube(spark, d), [5, 1, 5, -1])
    return c.select("row", "col", *[F.round(F.get("spectrum", F.lit(i)), 6).alias(f"b{i}") for i in range(4)])


@_query(f"with {_CUBE} select row - 3 as row, col - 5 as col, round(s[1], 6) as v from cube where row >= 3 and row < 15 and col >= 5 and col < 20")
def subregion(spark: SparkSession, d: str) -> DataFrame:
    return px.subregion(cube(spark, d), (3, 15), (5, 20), rebase=True).select("row", "col", F.round(F.get("spectrum", F.lit(0)), 6).alias("v"))


@_query(f"with {_CUBE}, r as (select * from (values (7, 0), (2, 1), (7, 2)) t(row, i)), c as (select * from (values (9, 0), (1, 1)) t(col, j)) select i as row, j as col, round(s[4], 6) as v from cube join r using (row) join c using (col)")
def subimage(spark: SparkSession, d: str) -> DataFrame:
    return px.subimage(cube(spark, d), [7, 2, 7], [9, 1]).select("row", "col", F.round(F.get("spectrum", F.lit(3)), 6).alias("v"))


@_query(f"with {_CUBE} select row, col, round(s[1], 6) as v from cube where row >= 1 and (row - 1) % 3 = 0 and col <= 24 and col % 4 = 0")
def strided(spark: SparkSession, d: str) -> DataFrame:
    c = cube(spark, d)
    return px.strided(c, slice(1, None, 3), slice(24, None, -4), _shape(c)).select("row", "col", F.round(F.get("spectrum", F.lit(0)), 6).alias("v"))


@_query(f"with {_CUBE}, n as (select max(row) + 1 as r from cube) select cast((case when row >= r // 3 then 1 else 0 end) + (case when row >= 2 * r // 3 then 1 else 0 end) as int) as tile_row, cast(case when col >= 12 then 1 else 0 end as int) as tile_col, cast(count(*) as bigint) as n from cube, n group by all")
def tiles(spark: SparkSession, d: str) -> DataFrame:
    c = cube(spark, d)
    return px.tiles(c, _shape(c), 3, 2).groupBy("tile_row", "tile_col").agg(F.count("*").alias("n"))


@_query(f"with {_LONG} select cast(band as int) as band, row, col, round(v, 6) as value from long")
def band_sequential(spark: SparkSession, d: str) -> DataFrame:
    """To band-sequential form, back, and to it again."""
    return px.to_long(px.from_long(px.to_long(cube(spark, d)))).select("band", "row", "col", F.round("value", 6).alias("value"))


@_query(f"with {_CUBE} select row, col, cast(case class_id when 1 then 5 when 2 then 5 else class_id end as int) as class_id from cube")
def recode(spark: SparkSession, d: str) -> DataFrame:
    return px.recode(cube(spark, d).select("row", "col", "class_id"), {1: 5, 2: 5}, allow_unmapped=True)


@_query(f"with {_CUBE} select cast(class_id as int) as source_id, cast((vec_id % 7) % 3 as int) as target_id, cast(count(*) as bigint) as n from cube group by all")
def class_contingency(spark: SparkSession, d: str) -> DataFrame:
    c = cube(spark, d)
    other = c.select("row", "col", ((F.col("row") * 25 + F.col("col")) % 7 % 3).cast("int").alias("class_id"))
    return px.contingency(c.select("row", "col", "class_id"), other)


@_query(f"with {_CUBE} select row, col, round(s[1], 6) as v from cube where class_id = 4")
def masked_pixels(spark: SparkSession, d: str) -> DataFrame:
    c = cube(spark, d)
    return px.masked(c.select("row", "col", "spectrum"), c.select("row", "col", "class_id"), 4).select("row", "col", F.round(F.get("spectrum", F.lit(0)), 6).alias("v"))


@_query(f"with {_CUBE}, n as (select max(row) as r from cube), m as (select row, col from cube where class_id = 3) select distinct c.row, c.col from cube c join m on c.row between m.row - 1 and m.row + 1 and c.col between m.col - 2 and m.col + 2")
def dilated_mask(spark: SparkSession, d: str) -> DataFrame:
    c = cube(spark, d)
    return px.dilate(c.select("row", "col", F.when(F.col("class_id") == 3, 1).otherwise(0).alias("class_id")), 3, 5, _shape(c))


_DIFF = "d1 as (select a.x - b.x as x, a.y - b.y as y from p a join p b on b.row = a.row + 1 and b.col = a.col + 1)"


@_query(f"with {_PART}, {_DIFF} select 0 as i, 0 as j, round(var_samp(x) / 2, 5) as cov from d1 union all select 0, 1, round(covar_samp(x, y) / 2, 5) from d1 union all select 1, 0, round(covar_samp(x, y) / 2, 5) from d1 union all select 1, 1, round(var_samp(y) / 2, 5) from d1")
def noise_from_diffs(spark: SparkSession, d: str) -> DataFrame:
    return _cov_long(spark, {0: stats.noise_from_diffs(parts(spark, d))}).select("i", "j", _r("cov", 5).alias("cov"))


def _window_sql(clip: bool) -> str:
    lo = "greatest(a.{0} - 2, 0)" if clip else "least(greatest(a.{0} - 2, 0), {1} - 5)"
    hi = "least(a.{0} + 2, {1} - 1)" if clip else "least(greatest(a.{0} - 2, 0), {1} - 5) + 4"
    on = " and ".join(f"b.{c} between {lo.format(c, n)} and {hi.format(c, n)}" for c, n in (("row", "nr"), ("col", "nc")))
    return f"with {_PART}, n as (select max(row) + 1 as nr, max(col) + 1 as nc from p) select a.row, a.col, round(avg(b.y), 5) as v from p a, n, p b where {on} group by a.row, a.col"


@_query(_window_sql(False))
def window_mean_shift(spark: SparkSession, d: str) -> DataFrame:
    p = parts(spark, d)
    return spatial.window_mean(p, 5, _shape(p), "shift").select("row", "col", _r(F.get("spectrum", F.lit(1)), 5).alias("v"))


@_query(_window_sql(True))
def window_mean_clip(spark: SparkSession, d: str) -> DataFrame:
    p = parts(spark, d)
    return spatial.window_mean(p, 5, _shape(p), "clip").select("row", "col", _r(F.get("spectrum", F.lit(1)), 5).alias("v"))


@_query(f"""with {_BG}, n as (select max(row) + 1 as nr, max(col) + 1 as nc from p),
k as (select p.*, least(greatest(row - 3, 0), nr - 7) as r0, least(greatest(col - 3, 0), nc - 7) as c0, least(greatest(row - 1, 0), nr - 3) as i0, least(greatest(col - 1, 0), nc - 3) as j0 from p, n),
m as (select k.row, k.col, any_value(k.x) as x, any_value(k.y) as y, avg(q.x) as mx, avg(q.y) as my from k join p q on q.row between r0 and r0 + 6 and q.col between c0 and c0 + 6 and not (q.row between i0 and i0 + 2 and q.col between j0 and j0 + 2) group by k.row, k.col)
select row, col, round((x - m.mx) * (x - m.mx) * ia + 2 * (x - m.mx) * (y - m.my) * ic + (y - m.my) * (y - m.my) * id, 5) + 0.0 as score from m, inv""")
def windowed_rx(spark: SparkSession, d: str) -> DataFrame:
    """RX against the mean around each pixel (outer window 7, inner 3) under the covariance of the image."""
    p = parts(spark, d)
    return spatial.windowed(p, "rx", 3, 7, _shape(p), cov=stats.calc_stats(p).cov).select("row", "col", _r("score", 5).alias("score"))


@_query("with s as (select o_totalprice as v, row_number() over (order by o_totalprice) - 1 as i, count(*) over () as n from orders), q as (select unnest([0.0, 0.02, 0.5, 0.98, 1.0]::double[]) as q) select q, round(v, 2) as value from q join s on i = cast(floor(q * (n - 1)) as bigint)")
def cdf_points(spark: SparkSession, d: str) -> DataFrame:
    q = [0.0, 0.02, 0.5, 0.98, 1.0]
    got = px.cdf_points(table(spark, d, "orders"), "o_totalprice", q)
    return spark.createDataFrame(list(zip(q, got, strict=True)), "q double, value double").select("q", F.round("value", 2).alias("value"))


@_query(f"""with {_PART}, l as (select min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from p)
select row, col, round((x - x0) / (x1 - x0), 6) as r, round((y - y0) / (y1 - y0), 6) as g, round((x - x0) / (x1 - x0), 6) as b from p, l""")
def rgb(spark: SparkSession, d: str) -> DataFrame:
    return render.get_rgb(parts(spark, d), [0, 1, 0]).select("row", "col", *[F.round(c, 6).alias(c) for c in "rgb"])


_KM = _PART + ", l as (select min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from p), k as (select i, x0 + (x1 - x0) * i / 3 as cx, y0 + (y1 - y0) * i / 3 as cy from l, (select unnest([0, 1, 2, 3]) as i)), a as (select p_partkey, any_value(x) as x, any_value(y) as y, min_by(i, (round((x - cx) * (x - cx) + (y - cy) * (y - cy), 6), i)) as i from p, k group by p_partkey)"


@_query(f"with {_KM}, c as (select i, avg(x) as x, avg(y) as y from a group by i) select cast(k.i as int) as cluster, round(coalesce(c.x, cx), 4) as x, round(coalesce(c.y, cy), 4) as y from k left join c using (i)")
def kmeans_step(spark: SparkSession, d: str) -> DataFrame:
    """Centers after one iteration from four along the diagonal."""
    _, c = iterate.kmeans(parts(spark, d), 4, max_iterations=1)
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(c)], "cluster int, x double, y double").select("cluster", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@_query(f"with {_MEANS} select row, col, cast(member as int) as member, round(list_sum(list_transform(list_zip(s, m), lambda z: abs(z[1] - z[2]))), 6) as l1, round(sqrt(list_sum(list_transform(list_zip(s, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) as l2 from cube, means")
def center_distances(spark: SparkSession, d: str) -> DataFrame:
    c = cube(spark, d)
    both = c.crossJoin(F.broadcast(_means(c)))  # a row a class on the right side
    return both.select("row", "col", "member", F.round(arrays.l1(F.col("spectrum"), F.col("m")), 6).alias("l1"), F.round(arrays.l2(F.col("spectrum"), F.col("m")), 6).alias("l2"))


_SIG = "with sp as (select distinct on (spectrumid) * from spectra order by spectrumid, loadedat), sa as (select distinct on (sampleid) * from samples order by sampleid, loadedat)"


@_query(_SIG + " select spectrumid, sampleid, name, sp.numvalues, round(sp.minwavelength, 4) as minwavelength from sp join sa using (sampleid)")
def signature_join(spark: SparkSession, d: str) -> DataFrame:
    """Every spectrum with its sample, once each."""
    sp = one_per_key(table(spark, d, "spectra").select("spectrumid", "sampleid", "numvalues", "minwavelength", "loadedat"), "spectrumid")
    sa = one_per_key(table(spark, d, "samples").select("sampleid", "name", "loadedat"), "sampleid")
    # A sample that a tenth of all spectra name: broadcast if the samples are measured to fit, else left to the skew join.
    return sp.join(maybe_broadcast(sa.select("sampleid", "name"), 64), "sampleid").select("spectrumid", "sampleid", "name", "numvalues", F.round("minwavelength", 4).alias("minwavelength"))


@_query("select phase, count(*) as n, count(distinct samplenum) as numbers from samples where phase is not null group by phase having count(*) > 2")
def catalogue_sql(spark: SparkSession, d: str) -> DataFrame:
    """SQL with an argument over the catalogue."""
    return signatures.query(spark, "select phase, count(*) as n, count(distinct samplenum) as numbers from Samples where phase is not null group by phase having count(*) > ?", [2], Samples=table(spark, d, "samples"))


_USGS = "with sa as (select distinct on (sampleid) * from usgs_samples order by sampleid, loadedat), wl as (select * from usgs_spectrometer where measurementtype = 'Wavelengths')"
_ASSUMED = _USGS + """, best as (select sampleid, min_by(spectrometerdataid, (case when lower(wl.name) = lower(coalesce(spectrometer, '')) then 1 when coalesce(spectrometer, '') <> '' and starts_with(lower(wl.name), lower(spectrometer[1:3])) then 2 else 3 end, spectrometerdataid)) as wl
from sa join wl using (libname, numvalues) group by sampleid)"""


def _usgs_samples(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return one_per_key(table(spark, d, "usgs_samples").select("sampleid", "libname", "spectrometer", "numvalues", "loadedat", *columns), "sampleid")


@_query(_ASSUMED + " select sampleid, best.wl as assumedwlspmeterdataid from sa left join best using (sampleid)")
def assumed_wavelengths(spark: SparkSession, d: str) -> DataFrame:
    return signatures.assume_wavelengths(_usgs_samples(spark, d), table(spark, d, "usgs_spectrometer")).select("sampleid", "assumedwlspmeterdataid")


@_query("""with sa as (select distinct on (sampleid) * from usgs_samples order by sampleid, loadedat), j as (select sampleid, sa.valuesarray as y, w.valuesarray as x from sa join usgs_spectrometer w on w.spectrometerdataid = sa.assumedwlspmeterdataid)
select sampleid, cast(len(x) as bigint) as n, round(cast(x[1] as double), 5) as first_x, round(cast(x[-1] as double), 5) as last_x, round(cast(y[1] as double), 5) as first_y from j where len(x) = len(y)""")
def usgs_spectra(spark: SparkSession, d: str) -> DataFrame:
    """Every library sample with the wavelengths of its assumed record, by its ends."""
    s = one_per_key(table(spark, d, "usgs_samples"), "sampleid")
    got = signatures.usgs_spectrum(s, table(spark, d, "usgs_spectrometer"))
    end = lambda c, i: F.round(F.element_at(c, i).cast("double"), 5)
    return got.select("sampleid", F.size("xdata").cast("long").alias("n"), end("xdata", 1).alias("first_x"), end("xdata", -1).alias("last_x"), end("ydata", 1).alias("first_y"))


@_query()
def resampled_spectra(spark: SparkSession, d: str) -> DataFrame:
    """All spectra in micrometers on twelve bands from 0.4 to 2.4."""
    s = units.resolve_spectra(one_per_key(table(spark, d, "spectra"), "spectrumid"))
    um = s.select("spectrumid", units.converted(F.col("xdata"), F.col("x_unit.unit"), units.WAVELENGTH).alias("xdata"), "ydata")
    return signatures.resampled_library(um, None, list(np.linspace(0.4, 2.4, 12)))


@_query()
def linear_discriminant(spark: SparkSession, d: str) -> DataFrame:
    """The image in the directions that part its classes best, of all 64 bands."""
    c = cube(spark, d)
    return linear.linear_discriminant(stats.class_stats(c, "class_id")).transform.apply(c)


@_query("select cast(i as int) as component, 1.0::double as within, 0.0::double as others from (select count(distinct label) - 1 as k from embeddings) u, range(64) t(i) where i < k")
def linear_discriminant_whitens(spark: SparkSession, d: str) -> DataFrame:
    """The pooled covariance of the classes as measured on the transformed image: one in each direction, none in common."""
    c = cube(spark, d)
    done = linear.linear_discriminant(stats.class_stats(c, "class_id")).transform.apply(c)
    cov = stats.cov_avg(stats.class_stats(done, "class_id"))
    others = np.abs(cov - np.diag(np.diag(cov))).max(axis=0)
    return spark.createDataFrame([(i, float(cov[i, i]), float(others[i])) for i in range(len(cov))], "component int, within double, others double").select("component", _r("within").alias("within"), _r("others").alias("others"))


@_query()
def noise_fraction(spark: SparkSession, d: str) -> DataFrame:
    """The four components of most signal to noise, of all 64 bands."""
    c = cube(spark, d)
    return linear.MinimumNoiseFraction(stats.calc_stats(c), stats.noise_from_diffs(c)).reduction(num=4).apply(c)


@_query("select cast(i as int) as component, 1.0::double as noise, 0.0::double as others from range(64) t(i)")
def noise_fraction_whitens(spark: SparkSession, d: str) -> DataFrame:
    """The noise of all 64 components as measured on the transformed image: one each, and none in common."""
    c = cube(spark, d)
    t = linear.MinimumNoiseFraction(stats.calc_stats(c), stats.noise_from_diffs(c)).reduction(num=64).apply(c)
    cov = stats.noise_from_diffs(t).cov
    others = np.abs(cov - np.diag(np.diag(cov))).max(axis=0)
    return spark.createDataFrame([(i, float(cov[i, i]), float(others[i])) for i in range(64)], "component int, noise double, others double").select("component", _r("noise").alias("noise"), _r("others").alias("others"))


@_query(f"with {_LONG} select cast(count(distinct (row, col)) as bigint) as n, round((count(distinct (row, col)) - 1) * count(distinct band), 5)::double as total from long")
def rx_of_all_bands(spark: SparkSession, d: str) -> DataFrame:
    """RX over 64 bands: the scores of all pixels add up to (pixels - 1) times bands, whatever the data."""
    c = cube(spark, d)
    return score.rx(c, stats.calc_stats(c)).agg(F.count("*").alias("n"), _r(F.sum("rx"), 5).alias("total"))


@_query(f"with {_LONG}, cv as (select a.band as i, b.band as j, covar_samp(a.v, b.v) as c from long a join long b using (row, col) group by all) select round(sum(case when i = j then c else 0 end), 8) as total, round(sum(c * c), 8) as squares from cv")
def principal_components_of_all_bands(spark: SparkSession, d: str) -> DataFrame:
    """64 eigenvalues by their sum and the sum of their squares, which the covariance tells."""
    w = np.asarray(linear.principal_components(stats.calc_stats(cube(spark, d))).eigenvalues, float)
    return spark.createDataFrame([(float(w.sum()), float((w * w).sum()))], "total double, squares double").select(_r("total", 8).alias("total"), _r("squares", 8).alias("squares"))


@_query(f"with {_LONG}, t as (select avg(v) as v, band from long where class_id = 2 group by band) select 0.0::double as mean_score, 1.0::double as of_target from t limit 1")
def matched_filter_of_all_bands(spark: SparkSession, d: str) -> DataFrame:
    """The matched filter over 64 bands: 0 on the whole, 1 for the target."""
    c = cube(spark, d)
    target = stats.class_stats(c, "class_id")[2].mean
    background = stats.calc_stats(c)
    one = spark.createDataFrame([(target.tolist(),)], "spectrum array<double>")
    return score.matched_filter(c, target, background).agg(_r(F.avg("mf")).alias("mean_score")).crossJoin(score.matched_filter(one, target, background).select(_r("mf").alias("of_target")))  # one row each


def _local_sql(value: str) -> str:
    return f"""with {_PART}, n as (select max(row) + 1 as nr, max(col) + 1 as nc from p),
k as (select p.*, least(greatest(row - 4, 0), nr - 9) as r0, least(greatest(col - 4, 0), nc - 9) as c0, least(greatest(row - 1, 0), nr - 3) as i0, least(greatest(col - 1, 0), nc - 3) as j0 from p, n),
m as (select k.row, k.col, any_value(k.x) as x, any_value(k.y) as y, avg(q.x) as mx, avg(q.y) as my, var_samp(q.x) as a, covar_samp(q.x, q.y) as c, var_samp(q.y) as d from k join p q on q.row between r0 and r0 + 8 and q.col between c0 and c0 + 8 and not (q.row between i0 and i0 + 2 and q.col between j0 and j0 + 2) group by k.row, k.col),
s as (select row, col, x - mx as x, y - my as y, 10.0 - mx as tx, 1500.0 - my as ty, d / (a * d - c * c) as ia, -c / (a * d - c * c) as ic, a / (a * d - c * c) as id from m),
z as (select row, col, x * x * ia + 2 * x * y * ic + y * y * id as xx, tx * x * ia + (tx * y + ty * x) * ic + ty * y * id as xt, tx * tx * ia + 2 * tx * ty * ic + ty * ty * id as tt from s)
select row, col, round({value}, 5) + 0.0 as score from z"""


def _local(spark: SparkSession, d: str, detector: str) -> DataFrame:
    p = parts(spark, d)
    return spatial.windowed(p, detector, 3, 9, _shape(p), target=np.array([10.0, 1500.0])).select("row", "col", _r("score", 5).alias("score"))


@_query(_local_sql("xx"))
def window_local_rx(spark: SparkSession, d: str) -> DataFrame:
    """RX against mean and covariance around each pixel (outer window 9, inner 3)."""
    return _local(spark, d, "rx")


@_query(_local_sql("xt / tt"))
def window_local_matched_filter(spark: SparkSession, d: str) -> DataFrame:
    return _local(spark, d, "mf")


@_query(_local_sql("least(1, greatest(0, xt * xt / (tt * xx)))"))
def window_local_ace(spark: SparkSession, d: str) -> DataFrame:
    return _local(spark, d, "ace")


@_query()
def pixel_purity(spark: SparkSession, d: str) -> DataFrame:
    return iterate.purity(cube(spark, d), 500, seed=3)


@_query("select cast(count(*) as bigint) as n, cast(1000 as bigint) as total from embeddings")
def pixel_purity_total(spark: SparkSession, d: str) -> DataFrame:
    """Each of 500 directions has one least and one greatest pixel, and no pixel is lost."""
    return iterate.purity(cube(spark, d), 500, seed=3).agg(F.count("*").alias("n"), F.sum("purity").alias("total"))


@_query(f"with {_CUBE} select cast(count(*) as bigint) as n, 0 as below, 0.0::double as worst from cube")
def convex_cone_rebuilds(spark: SparkSession, d: str) -> DataFrame:
    """Pixels as their abundances of endmembers and what is left: no abundance is below zero, and the sum gives the pixel again."""
    c = cube(spark, d).select((F.col("row") * 25 + F.col("col")).alias("key"), F.transform("spectrum", lambda v: v + 1).alias("spectrum"))
    keys, state = iterate.smacc(c, "key", min_endmembers=6)
    members = {r["key"]: np.array(r["spectrum"]) for r in c.where(F.col("key").isin(keys)).collect()}  # a row an endmember
    order = np.array([members[k] for k in keys])
    both = state.join(c, "key").select("spectrum", "residual", "abundances")
    away = F.zip_with(F.zip_with("spectrum", "residual", lambda a, b: a - b), "made", lambda a, b: F.abs(a - b))
    made = linear.LinearTransform(order.T).apply(both.withColumn("pixel", F.col("spectrum")).withColumn("spectrum", F.col("abundances")))
    made = made.select(F.col("spectrum").alias("made"), F.col("pixel").alias("spectrum"), "residual", "abundances")
    return made.agg(F.count("*").alias("n"), F.sum(F.exists("abundances", lambda v: v < -1e-9).cast("int")).cast("int").alias("below"), F.round(F.max(F.array_max(away)), 6).alias("worst"))


@_query()
def convex_cone(spark: SparkSession, d: str) -> DataFrame:
    c = cube(spark, d).select((F.col("row") * 25 + F.col("col")).alias("id"), F.transform("spectrum", lambda v: v + 1).alias("spectrum"))
    return iterate.smacc(c, "id", min_endmembers=6)[1]


@_query(f"""with {_LONG}, v as (select row, col, band, v + 1 as v from long),
chords as (select a.row, a.col, a.band as i, b.band as k, a.v as p, b.v as q from v a join v b using (row, col) where a.band <= b.band),
top as (select c.row, c.col, t.band, max(case when i = k then p else p + (q - p) * (t.band - i) / (k - i) end) as h from chords c join (select distinct band from v) t on t.band between i and k group by all)
select row, col, cast(band as int) as band, round(v.v / h, 6) as removed from v join top using (row, col, band)""")
def continuum_removed(spark: SparkSession, d: str) -> DataFrame:
    """The upper hull of each spectrum divided out: at a band, the hull is the highest of all chords over it."""
    c = cube(spark, d).withColumn("spectrum", F.transform("spectrum", lambda v: v + 1))
    return curves.remove_continuum(c, list(range(64))).select("row", "col", F.posexplode("removed").alias("band", "removed")).select("row", "col", "band", F.round("removed", 6).alias("removed"))


@_query()
def continuum_segmented(spark: SparkSession, d: str) -> DataFrame:
    c = cube(spark, d).withColumn("spectrum", F.transform("spectrum", lambda v: v + 1))
    return curves.remove_continuum(c, list(range(64)), "segmented").select("row", "col", F.posexplode("removed").alias("band", "removed")).select("row", "col", "band", F.round("removed", 6).alias("removed"))


_KM_ALL = _CUBE + """, lim as (select min(v) as lo, max(v) as hi, band from (select unnest(s) as v, generate_subscripts(s, 1) as band from cube) group by band),
recur(it, i, c) as (
select 0, k, list(lo + (hi - lo) * k / 9.0 order by band) from lim, range(10) t(k) group by k
union all
select any_value(r.it) + 1, r.i, coalesce(any_value(n.c), any_value(r.c)) from (select * from recur) r left join (
  select i, list(m order by band) as c from (select i, band, avg(v) as m from (
    select i, unnest(s) as v, generate_subscripts(s, 1) as band from (
      select vec_id, any_value(s) as s, min_by(i, (d, i)) as i from (select vec_id, s, i, list_sum(list_transform(list_zip(s, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d from cube, recur) group by vec_id)) group by i, band) group by i) n on n.i = r.i
where r.it < 20 group by r.i)"""


@_query(f"with recursive {_KM_ALL}, last as (select i, c from recur where it = 20) select row, col, cast(min_by(i, (list_sum(list_transform(list_zip(s, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), i)) as int) as cluster from cube, last group by row, col")
def kmeans_clusters(spark: SparkSession, d: str) -> DataFrame:
    return iterate.kmeans(cube(spark, d), 10, 20)[0].select("row", "col", "cluster")


@_query()
def perceptron_classes(spark: SparkSession, d: str) -> DataFrame:
    """Classes by a network of one hidden layer, trained on all labelled pixels and all 64 bands."""
    c = cube(spark, d)
    net = iterate.PerceptronClassifier([10])
    net.train(c, max_iterations=60, rate=0.3, batch=5)
    return net.classify(c).select("row", "col", "predicted")


@_query(f"with {_PART}, w as (select p.row, p.col, avg(q.y) as v from p join p q on q.row between p.row - 1 and p.row + 1 and q.col between p.col - 1 and p.col + 1 where p.row >= 2 and p.row < 20 and p.col % 7 = 3 group by p.row, p.col) select row, col, round(v, 5) as v from w")
def window_slices(spark: SparkSession, d: str) -> DataFrame:
    """A function of the window around some of the pixels: rows 2 to 19, each seventh column."""
    p = parts(spark, d)
    done = spatial.map_window(p, lambda b, _: np.nanmean(b[:, :, 1]), 3, _shape(p), "clip", rows=slice(2, 20), cols=slice(3, None, 7))
    return done.select("row", "col", _r(F.get("value", F.lit(0)), 5).alias("v"))


@_query(f"""with {_PART}, s as (select x as v, row_number() over (order by x) - 1 as i, count(*) over () as n from p), u as (select y as v, row_number() over (order by y) - 1 as i, count(*) over () as n from p),
l as (select least((select v from s where i = cast(floor(0.02 * (n - 1)) as bigint)), (select v from u where i = cast(floor(0.02 * (n - 1)) as bigint))) as lo, greatest((select v from s where i = cast(floor(0.98 * (n - 1)) as bigint)), (select v from u where i = cast(floor(0.98 * (n - 1)) as bigint))) as hi)
select row, col, round(least(1, greatest(0, (x - lo) / (hi - lo))), 6) as r, round(least(1, greatest(0, (y - lo) / (hi - lo))), 6) as g, round(least(1, greatest(0, (x - lo) / (hi - lo))), 6) as b from p, l""")
def rgb_common_stretch(spark: SparkSession, d: str) -> DataFrame:
    """Tails of 2 % cut off, the same limits for all bands."""
    return render.get_rgb(parts(spark, d), [0, 1, 0], stretch=0.02, stretch_all=False).select("row", "col", *[F.round(c, 6).alias(c) for c in "rgb"])


@_query(f"with {_CUBE} select row, col, (case class_id when 1 then 255 when 2 then 0 when 3 then 0 when 4 then 255 when 5 then 255 when 6 then 0 when 7 then 200 when 8 then 0 when 9 then 100 else 200 end) as r, (case class_id when 1 then 0 when 2 then 255 when 3 then 0 when 4 then 255 when 5 then 0 when 6 then 255 when 7 then 100 when 8 then 200 when 9 then 0 else 0 end) as g from cube")
def class_colours(spark: SparkSession, d: str) -> DataFrame:
    """The class map in the colours of classes; red and green."""
    return render.colour_classes(cube(spark, d).select("row", "col", "class_id")).select("row", "col", "r", "g")


@_query(f"with {_PART}, l as (select min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from p), q as (select row, col, (x - x0) / (x1 - x0) as u, (y - y0) / (y1 - y0) as v, class_id from p, l) select row, col, round(v, 6) as a, round(u, 6) as b, case when u >= 0.25 and u <= 0.75 and v <= 0.5 then 9 else class_id end as class_id from q")
def feature_points(spark: SparkSession, d: str) -> DataFrame:
    """The image as points of two features, with the points in a box given to another class."""
    p = parts(spark, d)
    at = features.points(p, p.select("row", "col", "class_id"), [1, 0])
    done, _ = features.reassign(at, {1: (0.25, 0.75), 0: (0.0, 0.5)}, 9)
    return at.drop("class_id").join(done, ["row", "col"]).select("row", "col", F.round(F.get("point", F.lit(0)), 6).alias("a"), F.round(F.get("point", F.lit(1)), 6).alias("b"), "class_id")
