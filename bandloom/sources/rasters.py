"""Binary image cubes with text headers, and two fixed binary formats, as Spark data sources.

Formats ``cube`` (a header file beside interleaved binary data), ``lan`` and
``aviris`` give rows (row, col, spectrum). Partitions are blocks of image rows;
filters on row and col, and the option ``bands``, keep what isn't asked for unread.
"""

from __future__ import annotations

import glob
import os
import re
import struct
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from bandloom.operators.render import CLASS_COLORS

#: The codes of data types in headers.
DTYPES = {1: "u1", 2: "i2", 3: "i4", 4: "f4", 5: "f8", 6: "c8", 9: "c16", 12: "u2", 13: "u4", 14: "i8", 15: "u8"}
#: What a header must tell, and data file suffixes tried.
REQUIRED = ("lines", "samples", "bands", "data type", "interleave", "byte order")
SUFFIXES = ("", ".img", ".dat", ".sli", ".hyspex", ".raw", ".bil", ".bip", ".bsq")
#: Fixed value: the file type of a library in headers.
LIBRARY_TYPE = "ENVI Spectral Library"
_SCHEMA = "row int, col int, spectrum array<double>"
_BLOCK_BYTES = 32 << 20
#: Values of a batch that leaves the reader.
_BATCH_VALUES = 1 << 21


class HeaderError(ValueError):
    pass


def parse_header(text: str) -> dict[str, str | list[str]]:
    """``key = value`` and ``key = {a, b}`` lines; keys in lower case, lines that start with ; left out."""
    lines = text.splitlines()
    if not lines or not lines[0].strip().upper().startswith("ENVI"):
        raise HeaderError("the header must start with ENVI")
    body = "\n".join(x for x in lines[1:] if not x.lstrip().startswith(";"))
    out: dict[str, str | list[str]] = {}
    for m in re.finditer(r"^[ \t]*([^=\n{}]+?)[ \t]*=[ \t]*(\{[^}]*\}|[^\n]*)", body, re.M):
        key, value = m[1].strip().lower(), m[2].strip()
        if value.startswith("{"):
            inner = value[1:].rstrip("}").strip()
            out[key] = inner if key == "description" else [v.strip() for v in inner.split(",")]
        else:
            out[key] = value
    return out


def render_header(meta: Mapping[str, object]) -> str:
    """The header text of ``meta``; a comma inside a list item becomes a hyphen."""
    first = ["description", "samples", "lines", "bands", "header offset", "file type", "data type", "interleave", "sensor type", "byte order"]
    lines = ["ENVI"]
    for k in [*[k for k in first if k in meta], *sorted(k for k in meta if k not in first)]:
        v = meta[k]
        if k == "description":
            lines.append(f"description = {{\n{v}}}")
        elif isinstance(v, (list, tuple)):
            lines.append(f"{k} = {{ {' , '.join(str(x).replace(',', '-') for x in v)} }}")
        else:
            lines.append(f"{k} = {v}")
    return "\n".join(lines) + "\n"


def supported_dtypes() -> list[str]:
    """The data types that headers have codes for."""
    return [np.dtype(t).name for t in DTYPES.values()]


@dataclass
class BandInfo:
    """Centers and widths of bands with their spread, unit and quantity, as headers tell them; what isn't told is None."""

    centers: list[float] | None = None
    bandwidths: list[float] | None = None
    centers_std: list[float] | None = None
    bandwidths_std: list[float] | None = None
    unit: str = ""
    quantity: str = ""

    @classmethod
    def of(cls, meta: Mapping[str, object]) -> BandInfo:
        numbers = lambda k: [float(v) for v in meta[k]] if isinstance(meta.get(k), (list, tuple)) else None
        return cls(numbers("wavelength"), numbers("fwhm"), unit=str(meta.get("wavelength units", "")), quantity="Wavelength" if "wavelength" in meta else "")

    @classmethod
    def of_table(cls, bands: DataFrame, unit: str = "nm") -> BandInfo:
        """Of a table of bands as ``read_band_table`` gives it; a row a band."""
        rows = sorted(bands.collect(), key=lambda r: r["band"])
        return cls(*([r[c] for r in rows] for c in ("center", "fwhm", "center_std", "fwhm_std")), unit=unit, quantity="Wavelength")

    def resampler(self, other: BandInfo) -> object:
        """The transform from these bands to others in the same unit."""
        from bandloom.operators.curves import band_resampler

        return band_resampler(self.centers, other.centers, self.bandwidths, other.bandwidths)


@dataclass
class Layout:
    """Where each value of an image is."""

    path: str
    shape: tuple[int, int, int]
    dtype: str
    interleave: str = "bip"
    offset: int = 0
    scale: float = 1.0
    meta: dict = field(default_factory=dict)

    @property
    def bands(self) -> BandInfo:
        return BandInfo.of(self.meta)

    @property
    def params(self) -> dict[str, object]:
        """Sizes, place and kind of the data by name."""
        r, c, b = self.shape
        return {"nrows": r, "ncols": c, "nbands": b, "offset": self.offset, "dtype": self.dtype, "interleave": self.interleave, "scale": self.scale, "filename": self.path, "metadata": dict(self.meta)}

    def mapped(self, mode: str = "r") -> np.memmap:
        """The file's values in the order of its interleave; what isn't sliced isn't read."""
        r, c, b = self.shape
        shape = {"bip": (r, c, b), "bil": (r, b, c), "bsq": (b, r, c)}[self.interleave]
        return np.memmap(self.path, np.dtype(self.dtype), mode, self.offset, shape)

    def block(self, rows: slice, cols: slice, bands: Sequence[int] | None = None) -> np.ndarray:
        """A block as (row, col, band), scaled, in doubles (complex kept); only its rows, columns and bands are read."""
        m, pick = self.mapped(), slice(None) if bands is None else list(bands)
        if self.interleave == "bip":
            out = m[rows, cols][..., pick]
        elif self.interleave == "bil":
            out = m[rows][..., cols][:, pick].transpose(0, 2, 1)
        else:
            out = np.stack([m[b][rows, cols] for b in (range(self.shape[2]) if bands is None else bands)], axis=2)
        return np.asarray(out).astype(complex if out.dtype.kind == "c" else float) / self.scale

    def write(self, mapped: np.memmap, rows: np.ndarray, cols: np.ndarray, values: np.ndarray) -> None:
        """Pixels into the mapped file; whole numbers are rounded."""
        v = np.round(values) if mapped.dtype.kind in "iu" else values
        if self.interleave == "bip":
            mapped[rows, cols] = v
        elif self.interleave == "bil":
            mapped[rows, :, cols] = v
        else:
            mapped[:, rows, cols] = v.T


def find_file(name: str, path: Sequence[str] = (".",)) -> str:
    """``name`` as it is, or in one of the folders of ``path`` and of BANDLOOM_DATA."""
    for d in ["", *path, *os.environ.get("BANDLOOM_DATA", "").split(os.pathsep)]:
        p = os.path.join(d, name) if d else name
        if os.path.isfile(p):
            return p
    raise FileNotFoundError(name)


def open_cube(header: str, data: str | None = None) -> Layout:
    """The layout of a cube or library from its header file."""
    header = find_file(header)
    with open(header, encoding="utf-8", errors="replace") as f:
        h = parse_header(f.read())
    missing = [k for k in REQUIRED if k not in h]
    if missing:
        raise HeaderError(f"the header lacks {', '.join(missing)}")
    if any(_offsets(h)):
        raise HeaderError("frame offsets are not supported")
    interleave = str(h["interleave"]).lower()
    if interleave not in ("bil", "bip", "bsq"):
        raise HeaderError(f"unknown interleave {interleave}")
    code = int(h["data type"])
    if code not in DTYPES:
        raise HeaderError(f"unknown data type {code}")
    if data is None:
        stem = header[: -len(".hdr")] if header.lower().endswith(".hdr") else header
        tried = [stem + x for s in SUFFIXES for x in (s, s.upper())]
        data = next((p for p in tried if os.path.isfile(p) and p != header), None)
        if data is None:
            raise FileNotFoundError(f"no data beside {header}")
    dtype = np.dtype(DTYPES[code]).newbyteorder(">" if int(h["byte order"]) else "<")
    lib = str(h.get("file type", "")).lower() == LIBRARY_TYPE.lower()
    shape = (int(h["lines"]), int(h["samples"]), int(h["bands"]))
    if lib:
        # A library is an image of one band whose lines are spectra.
        shape = (shape[0], 1, shape[1])
    return Layout(data, shape, dtype.str, "bip" if lib else interleave, int(h.get("header offset", 0)), float(h.get("reflectance scale factor", 1)), h)


def open_lan(path: str, signed: bool = True) -> Layout:
    """The layout of a LAN file: 128 bytes of header, line-interleaved data of 8 or 16 bits, in the byte order that gives sound sizes."""
    path = find_file(path)
    with open(path, "rb") as f:
        head = f.read(128)
    if head[:6] not in (b"HEADER", b"HEAD74"):
        raise HeaderError("not a LAN file")
    kind = "f" if head[:6] == b"HEADER" else "i"
    for order in "<>":
        pack, bands = struct.unpack(order + "hh", head[6:10])
        cols, rows = (int(v) for v in struct.unpack(order + kind * 2, head[16:24]))
        if 0 < bands < 10000 and 0 < cols < 10**7 and 0 < rows < 10**7 and pack in (0, 1, 2):
            if pack == 1:
                raise HeaderError("4-bit data is not supported")
            return Layout(path, (rows, cols, bands), ("i1" if signed else "u1") if pack == 0 else order + "i2", "bil", 128)
    raise HeaderError("no byte order gives a sound header")


def open_aviris(path: str) -> Layout:
    """The layout of an AVIRIS scene: 614 pixels of 224 bands a row, big-endian, reflectance times 10000."""
    path = find_file(path)
    rows, rest = divmod(os.path.getsize(path), 614 * 224 * 2)
    if rest or not rows:
        raise HeaderError("not an AVIRIS scene")
    return Layout(path, (rows, 614, 224), ">i2", "bip", 0, 10000.0)


def sniff(path: str) -> Layout:
    """A cube by its header, else LAN, else AVIRIS by its size."""
    for f in (open_cube, open_lan, open_aviris):
        try:
            return f(path)
        except (HeaderError, struct.error, UnicodeDecodeError):
            continue
    raise OSError(f"no known image format: {path}")


class _Block(InputPartition):
    def __init__(self, start: int, stop: int):
        super().__init__((start, stop))
        self.start, self.stop = start, stop


class _Reader(DataSourceReader):
    def __init__(self, layout: Layout, bands: list[int] | None):
        self.layout, self.bands = layout, bands
        self.low, self.high = [0, 0], [layout.shape[0], layout.shape[1]]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            axis = {("row",): 0, ("col",): 1}.get(getattr(f, "attribute", None))
            if axis is not None and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThanOrEqual, GreaterThan)):
                    self.low[axis] = max(self.low[axis], f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThanOrEqual, LessThan)):
                    self.high[axis] = min(self.high[axis], f.value + (not isinstance(f, LessThan)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        _, c, b = self.layout.shape
        size = max(1, _BLOCK_BYTES // (c * b * np.dtype(self.layout.dtype).itemsize))
        return [_Block(s, min(s + size, self.high[0])) for s in range(self.low[0], self.high[0], size)] or [_Block(0, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        c0, c1 = max(self.low[1], 0), min(self.high[1], self.layout.shape[1])
        width = max(1, len(self.bands) if self.bands is not None else self.layout.shape[2])
        step = max(1, _BATCH_VALUES // (width * max(1, c1 - c0)))
        for r in range(partition.start, partition.stop if c1 > c0 else partition.start, step):
            x = self.layout.block(slice(r, min(r + step, partition.stop)), slice(c0, c1), self.bands)
            h, w, b = x.shape
            flat = np.ascontiguousarray(x).ravel()
            values = pa.StructArray.from_arrays([pa.array(flat.real), pa.array(flat.imag)], names=["re", "im"]) if np.iscomplexobj(x) else pa.array(flat)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(r, r + h, dtype=np.int32), w)), pa.array(np.tile(np.arange(c0, c1, dtype=np.int32), h)), pa.ListArray.from_arrays(pa.array(np.arange(h * w + 1, dtype=np.int32) * b), values)], names=["row", "col", "spectrum"])


class _Source(DataSource):
    opener = staticmethod(sniff)

    def schema(self) -> str:
        """Complex cubes have spectra of struct(re, im)."""
        kind = np.dtype(type(self).opener(self.options["path"]).dtype).kind
        return _SCHEMA.replace("array<double>", "array<struct<re: double, im: double>>") if kind == "c" else _SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        bands, layout = self.options.get("bands"), type(self).opener(self.options["path"])
        picked = None if bands is None else [int(b) % layout.shape[2] if -layout.shape[2] <= int(b) < layout.shape[2] else int(b) for b in bands.split(",")]
        if picked is not None and any(b >= layout.shape[2] or b < 0 for b in picked):
            raise ValueError(f"bands must be in [0, {layout.shape[2]})")
        return _Reader(layout, picked)


class CubeSource(_Source):
    opener = staticmethod(open_cube)

    @classmethod
    def name(cls) -> str:
        return "cube"


class LanSource(_Source):
    opener = staticmethod(open_lan)

    @classmethod
    def name(cls) -> str:
        return "lan"


class AvirisSource(_Source):
    opener = staticmethod(open_aviris)

    @classmethod
    def name(cls) -> str:
        return "aviris"


class AnySource(_Source):
    @classmethod
    def name(cls) -> str:
        return "raster"


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for s in (CubeSource, LanSource, AvirisSource, AnySource):
        spark.dataSource.register(s)


def read_image(spark: SparkSession, path: str, bands: Sequence[int] | None = None) -> DataFrame:
    """pixels of an image of any known format."""
    register(spark)
    r = spark.read.format("raster")
    return (r if bands is None else r.option("bands", ",".join(map(str, bands)))).load(os.path.abspath(find_file(path)))


def complex_parts(pixels: DataFrame, spectrum: str = "spectrum") -> DataFrame:
    """Spectra of struct(re, im) as their moduli, and ``phase`` as their angles."""
    from pyspark.sql import functions as F

    length = lambda z: F.sqrt(z["re"] * z["re"] + z["im"] * z["im"])
    return pixels.withColumn("phase", F.transform(spectrum, lambda z: F.atan2(z["im"], z["re"]))).withColumn(spectrum, F.transform(spectrum, length))


def _code_of(dtype: object) -> int:
    code = {v: k for k, v in DTYPES.items()}.get(np.dtype(dtype).str[1:])
    if code is None:
        raise ValueError(f"no code for data type {dtype}")
    return code


def create_image(header: str, shape: Sequence[int] | None = None, dtype: str | None = None, interleave: str | None = None, meta: Mapping[str, object] | None = None, byteorder: int = 0, offset: int | None = None, force: bool = False, ext: str = ".img") -> Layout:
    """A new image of zeros, and its header; ``meta`` may tell what the other parameters don't.

    ``shape`` is (rows, columns, bands) or (rows, columns). Frame offsets are refused.
    """
    if not header.lower().endswith(".hdr"):
        raise ValueError("the header's name must end with .hdr")
    data = header[:-4] + ext
    if not force and (os.path.exists(header) or os.path.exists(data)):
        raise FileExistsError(header)
    head: dict[str, object] = {"header offset": 0, "interleave": "bip", **(meta or {})}
    if shape is not None:
        head |= {"lines": int(shape[0]), "samples": int(shape[1]), "bands": int(shape[2]) if len(shape) > 2 else 1}
    head |= {k: v for k, v in (("data type", None if dtype is None else _code_of(dtype)), ("interleave", interleave), ("header offset", offset)) if v is not None}
    head["byte order"] = byteorder
    missing = [k for k in REQUIRED if k not in head]
    if missing:
        raise HeaderError(f"the header lacks {', '.join(missing)}")
    if any(_offsets(head)):
        raise HeaderError("frame offsets are not supported")
    if str(head["interleave"]).lower() not in ("bil", "bip", "bsq") or int(head["data type"]) not in DTYPES:
        raise HeaderError("unknown interleave or data type")
    kind = np.dtype(DTYPES[int(head["data type"])]).newbyteorder(">" if byteorder else "<")
    layout = Layout(data, (int(head["lines"]), int(head["samples"]), int(head["bands"])), kind.str, str(head["interleave"]).lower(), int(head["header offset"]), meta=head)
    with open(data, "wb") as f:
        f.truncate(layout.offset + int(np.prod(layout.shape, dtype=np.int64)) * kind.itemsize)
    with open(header, "w", encoding="utf-8") as f:
        f.write(render_header(head))
    return layout


def _offsets(head: Mapping[str, object]) -> list[int]:
    found = [head.get(k, "0") for k in ("major frame offsets", "minor frame offsets")]
    return [int(x) for v in found for x in (v if isinstance(v, (list, tuple)) else [v])]


def write_pixels(pixels: DataFrame, layout: Layout, spectrum: str = "spectrum") -> int:
    """Puts ``pixels`` into the file of ``layout``, and returns their number.

    Every task writes the blocks of rows that it holds to their places, so the file
    must lie in a folder that all executors share. A task that runs again writes the
    same values to the same places. The driver gets a count a task.
    """
    import pyspark.sql.functions as F

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapped, n = layout.mapped("r+"), 0
        for b in batches:
            if b.num_rows:
                v = b.column("spectrum").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
                layout.write(mapped, b.column("row").to_numpy(), b.column("col").to_numpy(), v)
                n += b.num_rows
        mapped.flush()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    if not np.prod(layout.shape):
        return 0
    rows = pixels.select("row", "col", F.col(spectrum).cast("array<double>").alias("spectrum")).where("spectrum is not null")
    return int(rows.repartitionByRange("row").mapInArrow(put, "n long").agg(F.sum("n")).first()[0] or 0)


def add_band_info(meta: Mapping[str, object], centers: Sequence[float] | None = None, bandwidths: Sequence[float] | None = None, unit: str | None = None, overwrite: bool = False) -> dict[str, object]:
    """``meta`` with wavelengths, widths and their unit, where it has none yet or ``overwrite`` is set."""
    new = {"wavelength": centers, "fwhm": bandwidths, "wavelength units": unit}
    return {**meta, **{k: list(v) if k != "wavelength units" else v for k, v in new.items() if v is not None and (overwrite or k not in meta)}}


def save_image(pixels: DataFrame, header: str, dtype: str = "f4", interleave: str = "bip", byteorder: int = 0, force: bool = False, meta: Mapping[str, object] | None = None, ext: str = ".img", spectrum: str = "spectrum") -> None:
    """``pixels`` as a cube with its header, written by the tasks block by block (see ``write_pixels``). Missing pixels are 0."""
    from pyspark.sql import functions as F

    size = pixels.agg((F.max("row") + 1).alias("r"), (F.max("col") + 1).alias("c"), F.max(F.size(spectrum)).alias("b")).first()
    shape = tuple(int(v or 0) for v in size)
    head = {k: v for k, v in (meta or {}).items() if k != "header offset"}
    layout = create_image(header, shape, dtype, interleave, {"file type": "ENVI Standard", **head}, byteorder, 0, force, ext)
    write_pixels(pixels, layout, spectrum)


def save_classes(classes: DataFrame, header: str, names: Sequence[str] | None = None, colors: Sequence[Sequence[int]] | None = None, **options: object) -> None:
    """A class map as a one-band image, with the names and colours of its classes."""
    from pyspark.sql import functions as F

    n = int(classes.agg(F.max("class_id")).first()[0] or 0) + 1
    names = list(names or [f"class {i}" for i in range(n)])
    colors = colors or [CLASS_COLORS[i % len(CLASS_COLORS)] for i in range(n)]
    meta = {"classes": n, "class names": names, "class lookup": [v for c in colors for v in c], **dict(options.pop("meta", {}) or {})}
    save_image(classes.select("row", "col", F.array(F.col("class_id").cast("double")).alias("spectrum")), header, dtype=str(options.pop("dtype", "u1")), meta={**meta, "file type": "ENVI Classification"}, **options)


def read_library(spark: SparkSession, header: str) -> DataFrame:
    """library(spectrum_id, name, spectrum) of a library file; unnamed spectra are called 1 to n."""
    from pyspark.sql import functions as F

    lay = open_cube(header)
    names = lay.meta.get("spectra names", [])
    if names and len(names) != lay.shape[0]:
        raise HeaderError("as many names as spectra are needed")
    register(spark)
    rows = spark.read.format("cube").load(os.path.abspath(find_file(header)))
    named = F.array(*[F.lit(n) for n in (names or [str(i + 1) for i in range(lay.shape[0])])])
    return rows.select(F.col("row").cast("long").alias("spectrum_id"), F.get(named, F.col("row")).alias("name"), "spectrum")


def save_library(library: DataFrame, stem: str, bands: Mapping[str, Sequence[float]] | None = None, description: str | None = None) -> None:
    """A library as ``stem``.sli (32-bit floats) and its header, in the order of spectrum_id.

    The header holds the name of each spectrum, so names and ids go to the driver; the spectra are written by the tasks.
    """
    from pyspark.sql import functions as F

    named = library.select("spectrum_id", "name", F.size("spectrum").alias("n")).orderBy("spectrum_id").toArrow()
    ids = named.column("spectrum_id").to_numpy()
    if len(np.unique(ids)) < len(ids):
        raise ValueError("spectrum_id must be unique")
    width = int(named.column("n")[0].as_py()) if len(ids) else 0
    if any(n != width for n in named.column("n").to_pylist()):
        raise ValueError("spectra of several lengths")
    layout = Layout(stem + ".sli", (len(ids), 1, width), "<f4")
    with open(layout.path, "wb") as f:
        f.truncate(len(ids) * width * 4)
    place = library.sparkSession.sparkContext.broadcast(ids)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.searchsorted(place.value, b.column("spectrum_id").to_numpy()).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.zeros(len(at), np.int32)), b.column("spectrum")], names=["row", "col", "spectrum"])

    rows = library.select("spectrum_id", F.col("spectrum").cast("array<double>").alias("spectrum"))
    write_pixels(rows.mapInArrow(numbered, "row int, col int, spectrum array<double>"), layout)
    meta: dict[str, object] = {"samples": width, "lines": len(ids), "bands": 1, "header offset": 0, "file type": LIBRARY_TYPE, "data type": 4, "interleave": "bsq", "byte order": 0, "spectra names": named.column("name").to_pylist()}
    if description:
        meta["description"] = description
    meta |= {k: list(v) for k, v in (bands or {}).items()}
    with open(stem + ".hdr", "w", encoding="utf-8") as f:
        f.write(render_header(meta))


def read_band_table(spark: SparkSession, path: str) -> DataFrame:
    """bands(band, center, fwhm, center_std, fwhm_std, channel) of a calibration text; lines without five numbers are left out."""
    from pyspark.sql import functions as F

    text = spark.read.text(path)
    p = F.split(F.trim("value"), r"\s+")
    ok = F.regexp_like(F.trim("value"), F.lit(r"^[-+0-9.eE]+(?:\s+[-+0-9.eE]+){4}$"))
    rows = text.where(ok).select(*[p[i].cast("double").alias(n) for i, n in enumerate(("center", "fwhm", "center_std", "fwhm_std"))], p[4].cast("double").cast("int").alias("channel"))
    return rows.withColumn("band", F.col("channel") - 1).select("band", "center", "fwhm", "center_std", "fwhm_std", "channel")


def matching_files(folder: str, pattern: str) -> list[str]:
    return sorted(glob.glob(os.path.join(folder, pattern), recursive=True))
