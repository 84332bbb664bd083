import math

import pytest
from pyspark.sql import functions as F

from bandloom.operators import units

UM = [0.4, 0.5, 0.6, 0.7]
SPECTRA = "xunit string, yunit string, measurement string, xdata array<float>, ydata array<float>, x_unit string"


def resolve(spark, *rows):
    return units.resolve_spectra(spark.createDataFrame([(*r, "clash") for r in rows], SPECTRA)).collect()


@pytest.mark.parametrize(
    ("xunit", "remark", "x", "want"),
    [
        ("nm", "r", [v * 1000 for v in UM], "nanometer"),
        ("millimicrons", "r", [v * 1000 for v in UM], "nanometer"),
        ("tenths of nm", "r", [v * 1e4 for v in UM], "angstrom"),
        ("cm⁻¹", "r", [1e4 / v for v in UM], "wavenumber"),
        ("wavelength", "reflectance; slit 2 nm, abscissa in microns", UM, "micrometer"),
        ("n/a", "reflectance; grains 75-150 microns. x is nm", [v * 1000 for v in UM], "nanometer"),
        (None, "channel axis per cm", [1e4 / v for v in UM], "wavenumber"),
        (None, None, UM, "micrometer"),
        (None, None, [1e4 / v for v in UM], "wavenumber"),
    ],
)
def test_axis(spark, xunit, remark, x, want):
    assert resolve(spark, (xunit, "reflectance (fraction)", remark, x, [0.1] * 4))[0]["x_unit"]["unit"] == want


@pytest.mark.parametrize(
    ("yunit", "remark", "y", "want"),
    [
        ("REFLECTANCE PERECNT", "r", [50.0], "percent"),
        ("refl. ‰", "r", [500.0], "permille"),
        ("refl. in 1/10000", "r", [5000.0], "per_10000"),
        ("e (faction)", "r", [0.5], "fraction"),
        ("y", "reflectance; humidity 40 percent; values: reflectance given as a fraction of one", [0.5], "fraction"),
        ("-", "stored as emissivity in per cent", [0.4], "percent"),
        (None, None, [45.0, float("nan")], "percent"),
    ],
)
def test_share(spark, yunit, remark, y, want):
    assert resolve(spark, ("nm", yunit, remark, [400.0, 500.0, 600.0], y))[0]["y_unit"]["unit"] == want


def test_nulls_and_ambiguity(spark):
    a, b, c = resolve(spark, (None, None, None, None, None), ("nm", "%", "", [], []), (None, None, None, [8000.0, 9000.0, 10000.0], [0.5]))
    assert a["x_unit"] is None and a["y_unit"] is None and b["x_unit"] is None
    assert c["x_unit"]["unique"] is False
    assert resolve(spark) == []


def test_converted(spark):
    df = spark.createDataFrame([([100.0, float("nan")], "wavenumber"), ([50.0], None)], "v array<double>, u string")
    got = [r[0] for r in df.select(units.converted(F.col("v"), F.col("u"), units.WAVELENGTH)).collect()]
    assert got[0][0] == 100.0 and math.isnan(got[0][1]) and got[1] is None


def test_instruments_agree(spark):
    rows = [
        ("a", "I", 4, "Wavelengths", None, "Wavelengths I", UM, 1),
        ("a", "I", 4, "Wavenumber", "cm-1", "Wavenumber I", [1e4 / v for v in UM], 2),
        ("a", "I", 4, "Bandpass", "?", "Bandwidths I", [100.0] * 4, 3),
        ("a", "I", 4, "SRF", "none", "SRF I", [0.1] * 4, 4),
        (None, "I", 4, "Wavelengths", "nm", "Wavelengths I", [v * 1000 for v in UM], 5),
    ]
    df = spark.createDataFrame(rows, "libname string, name string, numvalues int, measurementtype string, unit string, description string, valuesarray array<double>, k int")
    got = {r["k"]: r["x_unit"] and r["x_unit"]["unit"] for r in units.resolve_instruments(df).collect()}
    assert got == {1: "micrometer", 2: "wavenumber", 3: "nanometer", 4: None, 5: "nanometer"}
    assert units.resolve_instruments(df.limit(0)).count() == 0
