"""ENVI cubes as a Spark data source: one input partition per range of rows."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)
from pyspark.sql.types import StructType

from canopy.schemas import SPECTRA

# Data type codes of the format.
DTYPES = {
    1: "u1", 2: "i2", 3: "i4", 4: "f4", 5: "f8", 12: "u2", 13: "u4", 14: "i8", 15: "u8",
}


def cube_paths(path: str, extension: str = ".dat") -> tuple[str, str]:
    """Header and data path from either of the two."""
    stem, dot, ext = path.rpartition(".")
    if ext.lower() == "hdr":
        return path, stem + extension
    return (stem if dot else path) + ".hdr", path


@dataclass(frozen=True)
class Header:
    width: int
    height: int
    bands: int
    interleave: str
    dtype: str
    offset: int
    wavelengths: tuple[float, ...]

    @classmethod
    def parse(cls, text: str) -> Header:
        """Fields of a ``key = value`` header; lists stand in braces over several lines."""
        fields = {}
        for m in re.finditer(r"^\s*([A-Za-z][\w ]*?)\s*=\s*(\{[^}]*\}|[^\n]*)", text, re.MULTILINE):
            fields[m.group(1).lower()] = m.group(2).strip()
        waves = fields.get("wavelength", "{}").strip("{}")
        order = ">" if int(fields.get("byte order", 0)) == 1 else "<"
        return cls(
            int(fields["samples"]), int(fields["lines"]), int(fields["bands"]),
            fields.get("interleave", "bsq").lower(), order + DTYPES[int(fields["data type"])],
            int(fields.get("header offset", 0)), tuple(float(w) for w in waves.split(",") if w.strip()),
        )

    def row_bytes(self) -> int:
        return self.width * self.bands * np.dtype(self.dtype).itemsize


@dataclass
class RowRange(InputPartition):
    path: str
    header: Header
    cube_id: str
    first: int
    last: int


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _headers(path: str) -> list[str]:
    from pyarrow import fs

    system, local = _open(path)
    info = system.get_file_info(local)
    if info.type == fs.FileType.Directory:
        found = system.get_file_info(fs.FileSelector(local, recursive=True))
        return sorted(f.path for f in found if f.path.lower().endswith(".hdr"))
    return [cube_paths(local)[0]]


class EnviReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.rows = int(options.get("rows_per_split", 64))
        self.extension = options.get("extension", ".dat")
        listed = options.get("bands", "")
        self.bands = [int(b) for b in listed.split(",")] if listed else None
        self.cubes: set[str] | None = None
        self.first, self.last = 0, 1 << 31

    def partitions(self) -> list[RowRange]:
        """Only headers are read here, several at a time."""
        system, _ = _open(self.path)

        def header(head: str) -> Header:
            with system.open_input_file(head) as f:
                return Header.parse(f.read().decode("utf-8", "ignore"))

        named = [(head, cube_paths(head, self.extension)[1]) for head in _headers(self.path)]
        named = [(head, data, data.rpartition("/")[2].rpartition(".")[0]) for head, data in named]
        named = [x for x in named if self.cubes is None or x[2] in self.cubes]
        with ThreadPoolExecutor(16) as pool:
            heads = list(pool.map(header, [x[0] for x in named]))
        parts = []
        for (_, data, cube), h in zip(named, heads):
            last = min(h.height, self.last)
            parts += [RowRange(data, h, cube, at, min(at + self.rows, last)) for at in range(self.first, last, self.rows)]
        return parts

    def read(self, part: RowRange):
        """Arrow batches of one line of pixels each."""
        h = part.header
        wanted = list(range(h.bands)) if self.bands is None else self.bands
        if not all(0 <= b < h.bands for b in wanted):
            raise ValueError(f"{part.path} has {h.bands} bands, asked for {wanted}")
        system, _ = _open(self.path)
        item = np.dtype(h.dtype).itemsize
        with system.open_input_file(part.path) as f:
            lines = part.last - part.first

            def values_at(place: int, n: int) -> np.ndarray:
                f.seek(h.offset + place * item)
                return np.frombuffer(f.read(n * item), h.dtype)

            if h.interleave == "bsq":  # the rows of a split lie together within a band
                bands = np.empty((len(wanted), lines, h.width), h.dtype)
                for i, b in enumerate(wanted):
                    bands[i] = values_at((b * h.height + part.first) * h.width, lines * h.width).reshape(lines, h.width)
            for row in range(part.first, part.last):
                if h.interleave == "bsq":
                    line = bands[:, row - part.first].T
                elif h.interleave == "bip":  # bands of a pixel lie side by side, so all are read
                    line = values_at(row * h.width * h.bands, h.width * h.bands).reshape(h.width, h.bands)[:, wanted]
                elif self.bands is None:
                    line = values_at(row * h.width * h.bands, h.width * h.bands).reshape(h.bands, h.width).T
                else:
                    line = np.column_stack([values_at((row * h.bands + b) * h.width, h.width) for b in wanted])
                values = pa.array(np.ascontiguousarray(line, dtype=float).ravel())
                ends = pa.array(np.arange(0, h.width * len(wanted) + 1, len(wanted), dtype="int32"))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part.cube_id] * h.width), pa.array(np.full(h.width, row, "int32")),
                        pa.array(np.arange(h.width, dtype="int32")), pa.ListArray.from_arrays(ends, values),
                    ],
                    names=["cube_id", "row", "col", "spectrum"],
                )


class PruningReader(EnviReader):
    """For sessions that hand filters to Python sources; others refuse a reader that takes them."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Cubes and rows that are not wanted are not read; Spark still checks every filter."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("cube_id",) and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.cubes = wanted if self.cubes is None else self.cubes & wanted
            elif column == ("row",):
                if isinstance(f, (EqualTo, GreaterThanOrEqual, GreaterThan)):
                    self.first = max(self.first, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThanOrEqual, LessThan)):
                    self.last = min(self.last, f.value + (not isinstance(f, LessThan)))
            yield f


class EnviDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "envi"

    def schema(self) -> StructType:
        return SPECTRA

    def reader(self, schema: StructType) -> EnviReader:
        options = dict(self.options)
        return (PruningReader if options.get("prune") == "true" else EnviReader)(options)


def read_envi(
    spark: SparkSession, path: str, rows_per_split: int = 64, extension: str = ".dat", bands: Sequence[int] | None = None
) -> DataFrame:
    """Spectra of one cube (``.hdr`` or data path) or of every cube under a folder.

    ``bands`` (from 0) makes spectra of these bands alone, in that order; of cubes stored by band or
    by line only their bytes are read. A cube that lacks one of them is an error. With ``spark.sql.python.filterPushdown.enabled``, filters on cube and row reach the reader.
    """
    spark.dataSource.register(EnviDataSource)
    prune = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format("envi").option("rows_per_split", rows_per_split).option("extension", extension)
    if bands is not None:
        if not bands:
            raise ValueError("no bands asked for")
        reader = reader.option("bands", ",".join(map(str, bands)))
    return reader.option("prune", prune).load(path)


def read_wavelengths(spark: SparkSession, path: str) -> DataFrame:
    """``cube, band, wavelength_nm`` from headers alone."""
    from pyspark.sql import functions as F

    heads = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.hdr").text(path, wholetext=True)
    listed = F.regexp_extract("value", r"(?is)wavelength\s*=\s*\{([^}]*)\}", 1)
    return heads.select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)\.hdr$", 1).alias("cube_id"),
        F.posexplode(F.transform(F.split(listed, ","), lambda v: F.trim(v).try_cast("double"))).alias("band", "wavelength_nm"),
    )
