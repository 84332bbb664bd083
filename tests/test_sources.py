import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandloom.sources import rasters, signatures
from bandloom.streaming.stats import RunningStats


def image(spark, x):
    return spark.createDataFrame([(i, j, x[i, j].tolist()) for i in range(x.shape[0]) for j in range(x.shape[1])], "row int, col int, spectrum array<double>")


@pytest.mark.parametrize("interleave", ["bip", "bil", "bsq"])
@pytest.mark.parametrize(("dtype", "order"), [("i2", 0), ("f4", 1), ("f8", 0)])
def test_cube_round_trip(spark, tmp_path, interleave, dtype, order):
    x = np.arange(3 * 4 * 5, dtype=float).reshape(3, 4, 5)
    hdr = str(tmp_path / "a.hdr")
    rasters.save_image(image(spark, x), hdr, dtype, interleave, order, meta={"wavelength": [1, 2, 3, 4, 5]})
    back = rasters.read_image(spark, hdr)
    assert all(np.allclose(r["spectrum"], x[r["row"], r["col"]]) for r in back.collect()) and back.count() == 12
    part = rasters.read_image(spark, hdr, bands=[4, 0]).where((F.col("row") == 1) & (F.col("col") >= 2))
    assert sorted(tuple(r["spectrum"]) for r in part.collect()) == [(x[1, 2, 4], x[1, 2, 0]), (x[1, 3, 4], x[1, 3, 0])]
    with pytest.raises(FileExistsError):
        rasters.save_image(image(spark, x), hdr)


def test_new_images_and_complex_cubes(spark, tmp_path):
    lay = rasters.create_image(str(tmp_path / "n.hdr"), (3, 4), "u2", "bsq", {"description": "x"})
    assert lay.shape == (3, 4, 1) and rasters.read_image(spark, str(tmp_path / "n.hdr")).count() == 12
    assert rasters.write_pixels(spark.createDataFrame([(2, 3, [6.6])], "row int, col int, spectrum array<double>"), lay) == 1
    assert rasters.read_image(spark, str(tmp_path / "n.hdr")).where("spectrum[0] <> 0").collect()[0]["spectrum"] == [7.0]
    for bad in ({"major frame offsets": ["1", "0"]}, {"interleave": "x"}):
        with pytest.raises(rasters.HeaderError):
            rasters.create_image(str(tmp_path / "m.hdr"), (1, 1, 1), "u1", meta=bad)
    with pytest.raises(rasters.HeaderError):
        rasters.create_image(str(tmp_path / "m.hdr"), dtype="u1")
    z = np.arange(12).reshape(2, 3, 2) * (1 + 2j)
    c = rasters.create_image(str(tmp_path / "z.hdr"), z.shape, "c8", "bil")
    m = c.mapped("r+")
    m[:] = z.transpose(0, 2, 1)
    m.flush()
    got = {(r["row"], r["col"]): [complex(v["re"], v["im"]) for v in r["spectrum"]] for r in rasters.read_image(spark, str(tmp_path / "z.hdr")).collect()}
    assert all(np.allclose(got[i, j], z[i, j]) for i in range(2) for j in range(3))
    mods = rasters.complex_parts(rasters.read_image(spark, str(tmp_path / "z.hdr"), [1])).where("row = 1 and col = 2").first()
    assert mods["spectrum"][0] == pytest.approx(abs(z[1, 2, 1])) and mods["phase"][0] == pytest.approx(np.angle(z[1, 2, 1]))
    assert lay.params["nbands"] == 1 and lay.bands == rasters.BandInfo() and "float32" in rasters.supported_dtypes()
    info = rasters.BandInfo.of({"wavelength": ["1", "2"], "fwhm": [1, 1], "wavelength units": "um"})
    assert info.centers == [1.0, 2.0] and info.unit == "um" and np.allclose(info.resampler(rasters.BandInfo([1.5], [1.0]))(np.array([3.0, 3.0])), 3.0)
    table = spark.createDataFrame([(1, 2.0, 0.1, 0.0, 0.0), (0, 1.0, 0.1, 0.0, 0.0)], "band int, center double, fwhm double, center_std double, fwhm_std double")
    assert rasters.BandInfo.of_table(table).centers == [1.0, 2.0]
    assert rasters.add_band_info({"fwhm": [1]}, [0.5], [0.1], "um") == {"fwhm": [1], "wavelength": [0.5], "wavelength units": "um"}
    with pytest.raises(Exception, match="bands must be"):
        rasters.read_image(spark, str(tmp_path / "z.hdr"), [5]).count()


def test_bad_headers(tmp_path):
    p = tmp_path / "b.hdr"
    p.write_text("ENVI\nlines = 1\n; note = {x}\nsamples = 2\n")
    with pytest.raises(rasters.HeaderError):
        rasters.open_cube(str(p))
    assert rasters.parse_header("ENVI\nA b = {1, 2\n, 3}\nc=d") == {"a b": ["1", "2", "3"], "c": "d"}


def test_lan_and_classes(spark, tmp_path):
    x = np.arange(12, dtype=">i2").reshape(2, 3, 2)
    p = tmp_path / "x.lan"
    p.write_bytes(b"HEAD74" + struct.pack(">hh", 2, 2) + b"\0" * 6 + struct.pack(">ii", 3, 2) + b"\0" * 104 + x.transpose(0, 2, 1).tobytes())
    rows = rasters.read_image(spark, str(p)).collect()
    assert all(np.allclose(r["spectrum"], x[r["row"], r["col"]]) for r in rows) and len(rows) == 6
    c = spark.createDataFrame([(0, 0, 1), (0, 1, 2)], "row int, col int, class_id int")
    rasters.save_classes(c, str(tmp_path / "c.hdr"))
    assert rasters.open_cube(str(tmp_path / "c.hdr")).meta["class names"] == ["class 0", "class 1", "class 2"]


def test_library(spark, tmp_path):
    lib = spark.createDataFrame([(2, "b", [3.0, 4.0]), (1, "a", [1.0, 2.0])], "spectrum_id long, name string, spectrum array<double>")
    rasters.save_library(lib, str(tmp_path / "l"), {"wavelength": [1.0, 2.0]})
    got = {r["name"]: r["spectrum"] for r in rasters.read_library(spark, str(tmp_path / "l.hdr")).collect()}
    assert got == {"a": [1.0, 2.0], "b": [3.0, 4.0]}


def test_signature_texts(spark, tmp_path):
    (tmp_path / "m.spectrum.txt").write_text("Name: Rock\nParticle Size: Liquid\nX Units: Wavelength (micrometers)\nY Units: Reflectance (percent)\n\n2.0 20\nbad line\n1.0 10\n")
    samples, spectra = signatures.catalogue(signatures.read_signatures(spark, str(tmp_path)))
    s, m = samples.first(), spectra.first()
    assert s["name"] == "Rock" and s["phase"] == "liquid" and m["xdata"] == [1.0, 2.0] and m["ydata"] == [10.0, 20.0]
    joined = signatures.signature(samples, spectra, m["spectrumid"])
    assert joined.count() == 1
    lib = signatures.resampled_library(spectra, [m["spectrumid"]], [1.5], [1.0]).first()
    assert lib["spectrum"][0] == pytest.approx(15.0)
    rec = signatures.parse_splib("liba Record=7: Mineral X ASDFRa AREF\n1.5\n-1.23e34\nx\n", "c/d.txt")
    assert rec["record"] == 7 and rec["spectrometer"] == "ASDFR" and rec["purity"] == "a" and np.isnan(rec["valuesarray"][1]) and rec["unread_lines"] == 1


@pytest.mark.parametrize(
    ("header", "kind", "unit", "name"),
    [
        ("liba Record=1: Wavelengths ASD 0.35-2.5 um", "Wavelengths", "micrometer", "ASD"),
        ("liba Record=2: Bandpass (FWHM) ASDFR StdRes", "Bandpass", "micrometer", "ASD"),
        ("libc Record=3: Bandpass (FWHM) Landsat8 (7 bands) nm", "Bandpass", "nanometer", "Landsat8"),
        ("libc Record=4: CRISM Waves JOINED MTR3", "Wavelengths", "micrometer", "CRISM JOINED MTR3"),
        ("liba Record=5: Wavenumber NIC4 Nicolet", "Wavenumber", "cm^-1", "NIC4"),
        ("libc Record=6: SRF Band 2 Sentinel-2", "SRF", "none", "Sentinel2"),
    ],
)
def test_instrument_headers(header, kind, unit, name):
    r = signatures.parse_instrument(header + "\n0.5\n", "liba/x.txt")
    assert (r["measurementtype"], r["unit"], r["name"]) == (kind, unit, name)


def test_splib_folder(spark, tmp_path):
    """The folder decides what a file is; error bars and broken headers end nothing; ids go from 1 to n."""
    files = {
        "liba/w.txt": "liba Record=1: Wavelengths ASD 0.35-2.5 um\n0.5\n0.6\n",
        "liba/w2.txt": "liba Record=2: Wavelengths BECK Beckman\n0.1\n0.2\n",
        "liba/broken.txt": "no header\n1\n",
        "liba/Chapter A/s.txt": "liba Record=9: Mineral of high resolution wavelength ASDFRa AREF\n0.3\n0.4\n",
        "liba/ChapterB/t.txt": "liba Record=8: Glass NIC4AA RREF\n0.3\nxx\n0.5\n",
        "liba/errorbars/e.txt": "liba Record=7: Glass NIC4aa RREF\n0.3\n",
    }
    for n, text in files.items():
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text(text)
    samples, instruments = (x.cache() for x in signatures.read_splib(spark, str(tmp_path)))
    assert sorted(r["record"] for r in samples.collect()) == [8, 9]
    assert sorted((r["filename"], r["error"] is None) for r in instruments.collect()) == [("broken.txt", False), ("w.txt", True), ("w2.txt", True)]
    s = samples.withColumn("sampleid", F.col("record"))
    i = instruments.where("error is null").withColumn("spectrometerdataid", F.col("record"))
    got = signatures.assume_wavelengths(s, i)
    assert {r["sampleid"]: (r["spectrometer"], r["purity"], r["assumedwlspmeterdataid"]) for r in got.collect()} == {9: ("ASDFR", "a", 1), 8: ("NIC4", "aa", 1)}
    spectrum = signatures.usgs_spectrum(got, i, 9).first()
    assert np.allclose(spectrum["xdata"], [0.5, 0.6]) and np.allclose(spectrum["ydata"], [0.3, 0.4])
    in_nm = i.withColumn("unit", F.lit("nanometer")).withColumn("valuesarray", F.transform("valuesarray", lambda v: (v * 1000).cast("float")))
    for instr in (i, in_nm):
        lib = signatures.usgs_library(got, instr, [9], [0.55], [0.1]).first()
        assert lib["spectrum_id"] == 9 and lib["spectrum"][0] == pytest.approx(0.35, abs=1e-3)
    assert {r["told"] for r in signatures.splib_header(instruments.where("record = 1")).collect()} == {"liba Record=1: Wavelengths micrometer Wavelengths ASD 0.35-2.5 um"}
    for k in range(5):
        (tmp_path / f"{k}.spectrum.txt").write_text(f"Name: Rock {k}\n\n1.0 {k}\n")
    names = {r["sampleid"]: r["name"] for r in signatures.catalogue(signatures.read_signatures(spark, str(tmp_path)))[0].collect()}
    assert names == {k + 1: f"Rock {k}" for k in range(5)}


def test_running_statistics(spark):
    x = np.random.default_rng(0).random((2, 10, 3))
    run = RunningStats()
    for i in range(2):
        run.update(image(spark, x[i : i + 1]), i)
        run.update(image(spark, x[i : i + 1]), i)
    assert np.allclose(run.stats.cov, np.cov(x.reshape(-1, 3).T)) and run.stats.nsamples == 20
