"""Text files of four signature libraries, and the catalogue of samples and spectra made of them."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from bandloom.common import maybe_broadcast
from bandloom.operators.curves import resampling_matrix
from bandloom.session import cut

_SPECTRUM = "path string, name string, type string, class string, subclass string, particlesize string, samplenum string, owner string, origin string, phase string, description string, instrument string, measurement string, xunit string, yunit string, xdata array<float>, ydata array<float>"
_FIELDS = [f.split()[0] for f in _SPECTRUM.split(", ")]
#: Instruments and the ways in which headers of instrument files write them; the first instrument of which one occurs counts.
INSTRUMENTS = {
    "ASD": ("ASD",),
    "ASTER": ("ASTER",),
    "AVIRIS": ("AVIRIS", "aviris"),
    "BECK": ("BECK",),
    "CRISM JOINED MTR3": ("CRISM Bandpass(FWHM) JOINED MTR3", "CRISM Waves JOINED MTR3", "CRISM Bandpass JOINED MTR3", "CRISM JOINED MTR3"),
    "CRISM GLOBAL": ("CRISM Bandpass(FWHM) GLOBAL", "CRISM Wavelengths GLOBAL", "CRISM Waves GLOBAL", "CRISM GLOBAL"),
    "Hyperion": ("Hyperion",),
    "HyMap2": ("HyMap2",),
    "Landsat8": ("Landsat8",),
    "M3": ("M3",),
    "NIC4": ("NIC4",),
    "Sentinel2": ("Sentinel2", "Sentinel-2"),
    "VIMS": ("VIMS",),
    "WorldView3": ("WorldView3",),
}
#: Kinds of instrument records by what the header in lower case holds, in the order in which they are tried.
KINDS = (("wavelength", "Wavelengths"), ("waves", "Wavelengths"), ("bandpass", "Bandpass"), ("fwhm", "Bandpass"), ("bandwidths", "Bandpass"), ("resolution", "Resolution"), ("wavenumber", "Wavenumber"), ("srf", "SRF"))


def _pairs(lines: Sequence[str]) -> tuple[list[float], list[float]]:
    """Two columns of numbers in rising x; a line that isn't two numbers is skipped."""
    xy = []
    for line in lines:
        p = line.split()
        try:
            xy.append((float(p[0]), float(p[1])))
        except (IndexError, ValueError):
            continue
    if len(xy) > 1 and xy[0][0] > xy[-1][0]:
        xy.reverse()
    return [x for x, _ in xy], [y for _, y in xy]


def _headed(text: str) -> tuple[dict[str, str], list[str]]:
    """``key: value`` lines (a value may go on in the next ones) up to the numbers, and the lines of numbers."""
    head: dict[str, str] = {}
    key, lines = None, text.replace("\r\n", "\n").split("\n")
    for i, line in enumerate(lines):
        if re.fullmatch(r"\s*[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?\s+[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?\s*", line):
            return head, lines[i:]
        if m := re.match(r"\s*([A-Za-z][\w ./]*?)\s*:\s*(.*)$", line):
            key = m[1].lower()
            head[key] = m[2].strip()
        elif key and line.strip():
            head[key] += " " + line.strip()
    return head, []


def parse_keyed(text: str, path: str = "") -> dict:
    """A file of ``key: value`` lines and two columns (both catalogues of that layout)."""
    h, rows = _headed(text)
    x, y = _pairs(rows)
    size = h.get("particle size", "")
    phase = "liquid" if size.lower() == "liquid" else "solid" if size else "unknown"
    instrument = h.get("measurement", "") if "instrument" not in h else h["instrument"]
    return {
        "path": path, "name": h.get("name", h.get("sample name")), "type": h.get("type"), "class": h.get("class"), "subclass": h.get("subclass") or h.get("sub class") or h.get("genus"), "particlesize": size, "samplenum": h.get("sample no.", h.get("sample number")),
        "owner": h.get("owner"), "origin": h.get("origin"), "phase": phase, "description": h.get("description"), "instrument": instrument, "measurement": h.get("measurement"),
        "xunit": re.sub(r"[Mm]icrometers?\b", "micrometers", h.get("x units", "")), "yunit": re.sub(r"[Pp]ercentage\b", "percent", h.get("y units", "")), "xdata": x, "ydata": y,
    }


def parse_relab(text: str, path: str = "") -> dict:
    """A count line, pairs of wavelength and reflectance, then lines of remarks."""
    lines = text.replace("\r\n", "\n").split("\n")
    x, y = _pairs([p for p in lines[1:] if len(p.split()) == 2])
    notes = [p.strip() for p in lines[1:] if p.strip() and not re.fullmatch(r"[-+\d.eE\s]+", p)]
    return {n: None for n in _FIELDS} | {"path": path, "name": notes[0] if notes else os.path.basename(path), "samplenum": os.path.splitext(os.path.basename(path))[0], "type": "rock", "phase": "unknown", "origin": "unknown", "description": "; ".join(notes[1:]), "xunit": "wavelength (nanometers)", "yunit": "reflectance (fraction)", "xdata": x, "ydata": y}


def _recorded(text: str, path: str) -> tuple[str, str, int, str, np.ndarray, int]:
    """(header, library, record, description, values, lines that are no number) of a file of one number a line.

    -1.23e34 marks deleted channels and becomes NaN. A line that is no number is left out and counted.
    """
    lines = text.replace("\r\n", "\n").split("\n")
    head = lines[0].strip() if lines else ""
    m = re.match(r"(\S+)\s+Record=(\d+):\s*(.*)$", head)
    if not m:
        raise ValueError(f"no record header in {path}")
    values, bad = [], 0
    for v in lines[1:]:
        try:
            values.append(float(v))
        except ValueError:
            bad += bool(v.strip())
    got = np.array(values, np.float32)
    got[got < -1e34] = np.nan
    return head, m[1], int(m[2]), " ".join(m[3].split()), got, bad


def parse_instrument(text: str, path: str = "") -> dict:
    """An instrument file: its kind, unit and instrument are told by the header line; an unknown kind or instrument raises ValueError."""
    head, lib, record, description, values, bad = _recorded(text, path)
    kind = next((k for w, k in KINDS if w in head.lower()), None)
    name = next((n for n, ways in INSTRUMENTS.items() if any(w in head for w in ways)), None)
    if kind is None or name is None:
        raise ValueError(f"unknown {'kind' if kind is None else 'instrument'} in the header of {path}")
    unit = {"Wavenumber": "cm^-1", "SRF": "none"}.get(kind) or ("nanometer" if re.search(r"\bnm\b", head) or "nanometer" in head else "micrometer")
    return _splib_row(path, lib, record, description, head, values, bad, measurementtype=kind, unit=unit, name=name)


def parse_splib(text: str, path: str = "") -> dict:
    """A sample file: the last words of the header are the spectrometer with the purity of the sample, and the kind of measurement."""
    head, lib, record, description, values, bad = _recorded(text, path)
    tail = description.split()
    coded = tail[-2] if len(tail) > 1 else ""
    spec = re.fullmatch(r"([A-Z0-9]+)([a-z]+)", coded) or re.fullmatch(r"([A-Z]+[0-9])([A-Z]+)", coded)
    if spec is None:
        raise ValueError(f"no spectrometer in the header of {path}")
    return _splib_row(path, lib, record, description, head, values, bad, spectrometer=spec[1], purity=spec[2].lower(), measurementtype=tail[-1])


def _splib_row(path: str, lib: str, record: int, description: str, head: str, values: np.ndarray, bad: int, **told: str) -> dict:
    own = {"path": path, "libname": lib, "record": record, "description": description, "header": head, "chapter": os.path.basename(os.path.dirname(path)), "filename": os.path.basename(path), "valuesarray": values, "unread_lines": bad}
    return {n: None for n in ("spectrometer", "purity", "measurementtype", "unit", "name", "error")} | own | told


def _either(text: str, path: str, samples: bool) -> dict:
    try:
        return parse_splib(text, path) if samples else parse_instrument(text, path)
    except ValueError as e:
        empty = _splib_row(path, "", 0, "", "", np.empty(0, np.float32), 0)
        return empty | {"libname": None, "record": None, "error": str(e)}


def _parser(fn: Callable[[str, str], dict], columns: list[str]) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([fn(t, p) for t, p in zip(b["value"], b["path"], strict=True)], columns=columns)

    return run


def _texts(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    r = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    return r.text(folder, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))


def read_signatures(spark: SparkSession, folder: str, layout: str = "keyed") -> DataFrame:
    """One row a file: ``layout`` keyed (``*spectrum.txt``) or relab (``*.asc``)."""
    glob, fn = {"keyed": ("*spectrum.txt", parse_keyed), "relab": ("*.asc", parse_relab)}[layout]
    return _texts(spark, folder, glob).mapInPandas(_parser(fn, _FIELDS), _SPECTRUM)


def catalogue(signatures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(samples, spectra) with ids in the order of the files' paths."""
    # Numbered 1 to n by ranges of paths: each range counts its own, and one number a range is summed up.
    ranged = cut(signatures.repartitionByRange("path").sortWithinPartitions("path").withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("path"))
    ordered = ranged.join(maybe_broadcast(bases, 16), "part").withColumn("sampleid", F.col("base") + place)
    samples = ordered.select("sampleid", "name", "type", "class", "subclass", "particlesize", "samplenum", "owner", "origin", "phase", "description")
    spectra = ordered.select(
        F.col("sampleid").alias("spectrumid"), "sampleid", F.lit(-1).cast("long").alias("sensorcalibrationid"), "instrument", F.lit("unknown").alias("environment"), "measurement", "xunit", "yunit",
        F.array_min("xdata").cast("double").alias("minwavelength"), F.array_max("xdata").cast("double").alias("maxwavelength"), F.size("xdata").cast("long").alias("numvalues"), "xdata", "ydata",
    )
    return samples, spectra


_SPLIB = "path string, libname string, record long, description string, header string, spectrometer string, purity string, measurementtype string, unit string, name string, chapter string, filename string, valuesarray array<float>, unread_lines long, error string"


def read_splib(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(samples, instrument records) of a library folder.

    The place of a file decides: ``library/*.txt`` are instrument files,
    ``library/chapter/*.txt`` samples; the chapter ``errorbars`` is skipped, and so
    is what lies elsewhere. A file whose header can't be read gives a row with
    ``error``, and no file ends the job.
    """
    cols = [f.split()[0] for f in _SPLIB.split(", ")]
    depth = len(re.sub(r"^[a-z]+:/*", "", os.path.abspath(folder) if "://" not in folder else folder).strip("/").split("/"))
    below = F.slice(F.split(F.regexp_replace(F.url_decode("path"), r"^[a-z]+:/*", ""), "/"), depth + 1, 10)
    texts = _texts(spark, folder, "*.txt").withColumn("below", below)

    def parsed(at: int) -> DataFrame:
        rows = texts.where((F.size("below") == at) & (F.get("below", F.lit(1)) != "errorbars")).drop("below")
        rows = rows.mapInPandas(_parser(lambda t, p: _either(t, p, at == 3), cols), _SPLIB)
        sound = F.filter("valuesarray", lambda v: ~F.isnan(v))
        return rows.withColumns({"numvalues": F.size("valuesarray").cast("long"), "minvalue": F.array_min(sound).cast("double"), "maxvalue": F.array_max(sound).cast("double")})

    return parsed(3), parsed(2)


def assume_wavelengths(samples: DataFrame, instruments: DataFrame) -> DataFrame:
    """Each sample (sampleid, libname, spectrometer, numvalues) with the wavelength record that fits best, or null.

    First of the same library, size and instrument; then one whose name starts
    with the same three letters; then any of the same library and size. The
    smallest id counts. Instruments are summed up by (library, size, name), so
    every sample meets a row a name.
    """
    w = instruments.where("measurementtype = 'Wavelengths'").groupBy("libname", "numvalues", F.lower("name").alias("iname")).agg(F.min("spectrometerdataid").alias("wl"))
    known = w.groupBy("libname", "numvalues").agg(F.collect_list(F.struct("iname", "wl")).alias("known"))
    spec = F.lower(F.coalesce(F.col("spectrometer"), F.lit("")))
    rank = F.transform("known", lambda k: F.struct(F.when(k["iname"] == spec, 1).when((spec != "") & F.startswith(k["iname"], F.substring(spec, 1, 3)), 2).otherwise(3).alias("rank"), k["wl"].alias("wl")))
    joined = samples.drop("assumedwlspmeterdataid").join(maybe_broadcast(known, 4096), ["libname", "numvalues"], "left")
    cols = [c for c in samples.columns if c != "assumedwlspmeterdataid"]
    return joined.select(*[F.col(f"`{c}`") for c in cols], F.array_min(rank)["wl"].alias("assumedwlspmeterdataid"))


def usgs_spectrum(samples: DataFrame, instruments: DataFrame, sample_id: int | None = None) -> DataFrame:
    """(sampleid, xdata, ydata): samples with the wavelengths of their assumed record; of one sample if ``sample_id`` is given.

    A sample without a record, or whose record has another number of values, gives no row.
    """
    s = samples if sample_id is None else samples.where(F.col("sampleid") == sample_id)
    s = s.select("sampleid", F.col("assumedwlspmeterdataid").alias("spectrometerdataid"), F.col("valuesarray").alias("ydata"))
    w = instruments.select("spectrometerdataid", F.col("valuesarray").alias("xdata"))
    return s.join(maybe_broadcast(w, 1 << 14), "spectrometerdataid").where(F.size("xdata") == F.size("ydata")).select("sampleid", "xdata", "ydata")


def usgs_library(samples: DataFrame, instruments: DataFrame, ids: Sequence[int] | None, centers: Sequence[float], fwhm: Sequence[float] | None = None) -> DataFrame:
    """(spectrum_id, place, spectrum) of samples on other bands in micrometers; wavelengths in nanometers are converted first."""
    nm = instruments.where(F.lower("unit").startswith("nanomet")).select(F.col("spectrometerdataid").alias("nm"))
    um = instruments.join(maybe_broadcast(nm, 16), F.col("spectrometerdataid") == F.col("nm"), "left").withColumn("valuesarray", F.transform("valuesarray", lambda v: F.when(F.col("nm").isNotNull(), v / 1000).otherwise(v.cast("double"))))
    return resampled_library(usgs_spectrum(samples, um.drop("nm")).withColumnRenamed("sampleid", "spectrumid"), ids, centers, fwhm)


def splib_header(record: DataFrame) -> DataFrame:
    """``record`` with ``told``: library, record, then description, spectrometer, purity and kind of a sample, or kind, unit and description of an instrument record."""
    lead = F.format_string("%s Record=%d:", F.col("libname"), F.col("record"))
    sample = F.concat_ws(" ", lead, "description", "spectrometer", "purity", "measurementtype")
    return record.withColumn("told", sample if "spectrometer" in record.columns and "unit" not in record.columns else F.when(F.col("unit").isNull(), sample).otherwise(F.concat_ws(" ", lead, "measurementtype", "unit", "description")))


def query(spark: SparkSession, sql: str, args: Sequence[object] = (), **tables: DataFrame) -> DataFrame:
    """SQL with positional ``?`` over named tables."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql, args=list(args)) if args else spark.sql(sql)


def as_lines(df: DataFrame) -> DataFrame:
    """Each row as text, its values joined by ``|``."""
    return df.select(F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("None")) for c in df.columns]).alias("line"))


def signature(samples: DataFrame, spectra: DataFrame, spectrum_id: int) -> DataFrame:
    """A spectrum with its sample; the filter is on the key, so row groups without it aren't read."""
    return spectra.where(F.col("spectrumid") == spectrum_id).join(samples.withColumnRenamed("loadedat", "sample_loadedat"), "sampleid")


def resampled_library(spectra: DataFrame, ids: Sequence[int] | None, centers: Sequence[float], fwhm: Sequence[float] | None = None) -> DataFrame:
    """(spectrum_id, place, spectrum) of the listed spectra on other bands, in the order of the list; of all, with place 0, if there is none.

    ``spectra`` has spectrumid, xdata in the unit of ``centers``, and ydata. A
    resampling matrix is built once for each distinct grid in a batch.
    """
    rows = spectra.select("spectrumid", "xdata", "ydata")
    if ids is None:
        rows = rows.withColumn("place", F.lit(0))
    else:
        rows = rows.join(F.broadcast(spectra.sparkSession.createDataFrame([(int(v), i) for i, v in enumerate(ids)], "spectrumid long, place int")), "spectrumid")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict[bytes, np.ndarray] = {}
        for b in batches:
            out = []
            for x, y in zip(b["xdata"], b["ydata"], strict=True):
                if x is None or y is None:
                    out.append(None)
                    continue
                x, y = np.asarray(x, float), np.asarray(y, float)
                order = np.argsort(x)
                k = x[order].tobytes()
                if k not in made:
                    made[k] = resampling_matrix(x[order], centers, None, fwhm)
                out.append(made[k] @ y[order])
            yield pd.DataFrame({"spectrum_id": b["spectrumid"], "place": b["place"], "spectrum": out})

    return rows.mapInPandas(run, "spectrum_id long, place int, spectrum array<double>")
