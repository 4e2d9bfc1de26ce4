"""Text sources: lines with their place, telemetry tables, radiometer files, media lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from canopy.constants import VIDEO_EXTENSIONS
from canopy.operators.ordered import row_numbers

RADIOMETER_MARKER = ">>>>>Begin Spectral Data<<<<<"


def read_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``file, split, place, line`` of every line, read in splits like any text file.

    ``(split, place)`` orders the lines of a file: the byte where the split starts, then
    the row id, which rises within a split.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("place"), F.rtrim(F.col("value"), F.lit("\r")).alias("line"),
    )


def name_lines(name: Column, value: Column) -> Column:
    """The lines of ``value``, each after its file's name and a tab, as ``read_named_lines`` takes them."""
    return F.array_join(F.transform(F.split(F.coalesce(value, F.lit("")), "\n"), lambda line: F.concat(name, F.lit("\t"), line)), "\n")


def read_named_lines(spark: SparkSession, path: str) -> DataFrame:
    """``read_lines`` of many small files kept in few large ones, where each line begins with its
    file's name and a tab. All lines of a name lie in one large file, in order."""
    lines = read_lines(spark, path)
    named = lambda i: F.regexp_extract("line", "(?s)^([^\t]*)\t(.*)$", i)
    return lines.select(named(1).alias("file"), "split", "place", named(2).alias("line"))


def numbered_lines(lines: DataFrame, out: str = "line_no") -> DataFrame:
    """Lines with their 0-based number in the file, one split at a time."""
    n = row_numbers(lines, ["file"], ["split", "place"], out, F.col("split"))
    return n.withColumn(out, F.col(out) - 1).drop("split", "place")


def read_telemetry_csv(spark: SparkSession, path: str) -> DataFrame:
    """``timestamp, lat, lon, alt``; a missing altitude is 0. Order by ``ts`` where needed."""
    # Columns are found by header name, extra ones are allowed.
    raw = spark.read.csv(path, header=True, enforceSchema=False)
    number = lambda c: F.col(c).try_cast("double")
    alt = number("alt") if "alt" in raw.columns else F.lit(None).cast("double")
    return raw.select(
        F.col("_metadata.file_path").alias("file"), number("timestamp").alias("ts"), number("lat").alias("lat"),
        number("lon").alias("lon"), F.coalesce(alt, F.lit(0.0)).alias("alt"),
    )


def parse_radiometer(lines: DataFrame) -> DataFrame:
    """Tab-separated numbers after the marker line of each file: ``file, line, wavelength, values``."""
    n = numbered_lines(lines)
    marks = n.filter(F.col("line").contains(RADIOMETER_MARKER)).groupBy("file").agg(F.min("line_no").alias("mark"))
    data = n.join(marks, "file").filter((F.col("line_no") > F.col("mark")) & (F.trim("line") != ""))
    numbers = F.transform(F.split(F.trim("line"), "\t"), lambda v: v.try_cast("double"))
    return data.select(
        "file", (F.col("line_no") - F.col("mark") - 1).cast("int").alias("line"), F.get(numbers, 0).alias("wavelength"),
        F.slice(numbers, 2, F.greatest(F.size(numbers) - 1, F.lit(0))).alias("values"),
    )


def read_radiometer(spark: SparkSession, path: str, extension: str = "txt") -> DataFrame:
    return parse_radiometer(read_lines(spark, path, f"*.{extension}"))


def _name(path: str | Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def categorize_media(files: DataFrame, path: str = "path") -> DataFrame:
    """Videos with their subtitle file of the same stem ('' when missing) and modality."""
    stem = F.regexp_replace(F.col(path), r"\.[^./]*$", "")
    ext = F.regexp_extract(F.col(path), r"\.([^./]*)$", 1)
    named = files.select(F.col(path).alias("path"), stem.alias("stem"), ext.alias("ext"))
    videos = named.filter(F.lower("ext").isin(*VIDEO_EXTENSIONS))
    # The lower-case extension wins where both exist.
    subs = named.filter(F.col("ext").isin("srt", "SRT")).groupBy("stem").agg(F.max("path").alias("metadata"))
    name, base = F.lower(_name("path")), F.lower(_name("stem"))
    split = base.endswith("_s") | base.endswith("-s") | base.contains("split")
    thermal = base.rlike("_t|-t|_ir|-ir|thermal|infrared") | name.rlike(r"_t\.|_ir\.")
    return videos.join(subs, "stem", "left").select(
        "path", F.coalesce("metadata", F.lit("")).alias("metadata"),
        F.when(split, "split").when(thermal, "thermal").otherwise("rgb").alias("modality"),
    )


def discover_cubes(files: DataFrame, kind: str = "rect", path: str = "path") -> DataFrame:
    """Cube data files of a kind: ``rect``, ``radiance`` or any ``.dat``."""
    tail = {"rect": "rect.dat", "radiance": "radiance.dat", "any": ".dat"}[kind]
    return files.filter(F.col(path).endswith(tail))


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """File paths under a folder; contents are not read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
        .load(path).select("path", "length")
    )


def media_schema() -> T.StructType:
    return T.StructType([T.StructField("path", T.StringType()), T.StructField("length", T.LongType())])
