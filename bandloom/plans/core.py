"""Queries of the data-cleaning operators of the core, by the names of the driver's contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from bandloom.common import one_per_key, table
from bandloom.operators import rejects, units

#: The cells of a raw spectrum record, in order.
RAW_SPECTRUM = T.StructType(
    [
        T.StructField("spectrumid", T.LongType()),
        T.StructField("sampleid", T.LongType()),
        T.StructField("sensorcalibrationid", T.LongType()),
        T.StructField("instrument", T.StringType()),
        T.StructField("environment", T.StringType()),
        T.StructField("measurement", T.StringType()),
        T.StructField("xunit", T.StringType()),
        T.StructField("yunit", T.StringType()),
        T.StructField("minwavelength", T.DoubleType()),
        T.StructField("maxwavelength", T.DoubleType()),
        T.StructField("numvalues", T.LongType()),
        T.StructField("xdata", T.ArrayType(T.FloatType())),
        T.StructField("ydata", T.ArrayType(T.FloatType())),
    ]
)


def parsed_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "spectra_raw")
    return rejects.parse_records(raw, "line", RAW_SPECTRUM, counts=["numvalues"], lists={"xdata": "numvalues", "ydata": "numvalues"})


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed_spectra(spark, sf_dir).where("reject_reason is not null").select("rawid").distinct()


def p1_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many distinct records fail for each reason."""
    return parsed_spectra(spark, sf_dir).where("reject_reason is not null").select("rawid", "reject_reason").distinct().groupBy("reject_reason").agg(F.count("*").alias("n_records"))


def p1_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that load, as typed rows, once each."""
    good, _ = rejects.split_rejects(parsed_spectra(spark, sf_dir), "line", RAW_SPECTRUM)
    return good.drop("loadedat").distinct().select("rawid", "spectrumid", "sampleid", "numvalues", "minwavelength", "maxwavelength", F.size("xdata").cast("long").alias("n_x"), F.round(F.aggregate("ydata", F.lit(0.0), lambda a, v: a + v), 3).alias("sum_y"))


def resolved_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["spectrumid", "xunit", "yunit", "measurement", "xdata", "ydata"]
    return units.resolve_spectra(table(spark, sf_dir, "spectra").select(*cols))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    spectra = resolved_spectra(spark, sf_dir)
    off = F.array_compact(F.array(F.when(F.col("x_unit.unit") != "micrometer", F.lit("x")), F.when(F.col("y_unit.unit") != "fraction", F.lit("y"))))
    ours = spectra.select(F.lit("spectra").alias("tab"), F.col("spectrumid").alias("recordid"), F.explode(off).alias("axis"))
    instruments = units.resolve_instruments(table(spark, sf_dir, "usgs_spectrometer"))
    theirs = instruments.where("x_unit.unit <> 'micrometer'").select(F.lit("usgs_spectrometer").alias("tab"), F.col("spectrometerdataid").alias("recordid"), F.lit("x").alias("axis"))
    return ours.unionByName(theirs).distinct()


def p5_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct spectra by the units found, and how many of them have more than one fitting unit."""
    s = resolved_spectra(spark, sf_dir).select("spectrumid", "x_unit", "y_unit").distinct()
    return s.groupBy(F.col("x_unit.unit").alias("x_unit"), F.col("y_unit.unit").alias("y_unit")).agg(
        F.count("*").alias("n_spectra"), F.sum((~F.col("x_unit.unique") | ~F.col("y_unit.unique")).cast("long")).alias("n_not_unique")
    )


def p5_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spectrum in micrometers and fractions of one: its arrays and bounds, and whether other units fit as well."""
    s = one_per_key(table(spark, sf_dir, "spectra"), "spectrumid")
    r = units.resolve_spectra(s)
    x_unit, y_unit = F.col("x_unit.unit"), F.col("y_unit.unit")
    lo, hi = units.converted_bounds(F.col("minwavelength"), F.col("maxwavelength"), x_unit)
    return r.select(
        "spectrumid", units.converted(F.col("xdata"), x_unit, units.WAVELENGTH).alias("x_um"), units.converted(F.col("ydata"), y_unit, units.FRACTION).alias("y_fraction"),
        lo.alias("minwavelength_um"), hi.alias("maxwavelength_um"), F.col("x_unit.unique").alias("x_unique"), F.col("y_unit.unique").alias("y_unique"),
    )


def p5_instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every array of usgs_spectrometer in micrometers, with the unit found and whether it is the only one that fits; responses have none."""
    r = units.resolve_instruments(table(spark, sf_dir, "usgs_spectrometer"))
    unit = F.col("x_unit.unit")
    return r.select("spectrometerdataid", "measurementtype", unit.alias("unit"), F.col("x_unit.unique").alias("unique"), units.converted(F.col("valuesarray"), unit, units.WAVELENGTH).alias("values_um"))


QUERIES = {f.__name__: f for f in (p1_found, p1_reasons, p1_loaded, p5_found, p5_units, p5_common, p5_instruments)}
ORACLES: dict[str, str] = {}

_CELL = '(?:"(?:[^"]|"")*"|[^,"]*)'
_NUM = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
#: Cells by a full match of the record, then the checks of the statement one by one.
_P1 = f"""with r as (select distinct rawid, line from spectra_raw),
c as (select rawid, line is not null and regexp_full_match(line, '(?s){_CELL}(?:,{_CELL}){{12}}') as shaped, regexp_extract_all(line || ',', '(?s)({_CELL}),', 1) as cells from r),
u as (select rawid, shaped, cells[11] as nv, list_transform(cells, lambda x: case when x like '"%' then replace(x[2:-2], '""', '"') else x end) as cells from c),
k as (select rawid, shaped, coalesce(cells[11], '') as nv, coalesce(cells[12], '') as x, coalesce(cells[13], '') as y from u),
j as (select rawid, shaped and regexp_full_match(nv, '[0-9]+') and regexp_full_match(x, '[ \\t]*{_NUM}(?:[ \\t]+{_NUM})*[ \\t]*') and regexp_full_match(y, '[ \\t]*{_NUM}(?:[ \\t]+{_NUM})*[ \\t]*') as reads,
try_cast(nv as hugeint) as n, len(string_split_regex(trim(x, ' \t'), '[ \\t]+')) as nx, len(string_split_regex(trim(y, ' \t'), '[ \\t]+')) as ny from k)
select distinct rawid from j where not (reads and coalesce(n, 0) >= 1 and n = nx and n = ny)"""
ORACLES["p1_found"] = _P1
_CELLS = f"""with r as (select distinct rawid, line from spectra_raw),
c as (select rawid, line, line is null or (contains(line, '"') and not regexp_full_match(line, '(?s){_CELL}(?:,{_CELL})*')) as unsound, regexp_extract_all(line || ',', '(?s)({_CELL}),', 1) as raw from r),
k as (select rawid, line, unsound, len(raw) as n, list_transform(raw, lambda x: case when x like '"%' then replace(x[2:-2], '""', '"') else x end) as cells from c),
m as (select *, regexp_full_match(coalesce(cells[11], ''), '[0-9]+') as counted, regexp_full_match(coalesce(cells[12], ''), '[ \\t]*{_NUM}(?:[ \\t]+{_NUM})*[ \\t]*') as xs, regexp_full_match(coalesce(cells[13], ''), '[ \\t]*{_NUM}(?:[ \\t]+{_NUM})*[ \\t]*') as ys,
string_split_regex(trim(coalesce(cells[12], ''), ' \t'), '[ \\t]+') as x, string_split_regex(trim(coalesce(cells[13], ''), ' \t'), '[ \\t]+') as y from k),
w as (select *, case when counted then try_cast(cells[11] as hugeint) end as want from m),
j as (select *, case when line is null then 'missing' when unsound then 'quoting' when n <> 13 then 'column_count' when coalesce(want, 0) < 1 then 'not_a_count: numvalues' when not xs then 'not_numbers: xdata' when not ys then 'not_numbers: ydata'
when len(x) <> want then 'length_mismatch: xdata' when len(y) <> want then 'length_mismatch: ydata' end as reject_reason from w)"""
ORACLES["p1_reasons"] = _CELLS + " select reject_reason, cast(count(*) as bigint) as n_records from (select distinct rawid, reject_reason from j where reject_reason is not null) group by reject_reason"
ORACLES["p1_loaded"] = _CELLS + """ select distinct rawid, try_cast(trim(cells[1]) as bigint) as spectrumid, try_cast(trim(cells[2]) as bigint) as sampleid, cast(want as bigint) as numvalues, try_cast(trim(cells[9]) as double) as minwavelength, try_cast(trim(cells[10]) as double) as maxwavelength,
cast(len(x) as bigint) as n_x, round(list_sum(list_transform(y, lambda v: cast(cast(v as float) as double))), 3) as sum_y from j where reject_reason is null"""
