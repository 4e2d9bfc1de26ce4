"""Drone subtitle telemetry, current and legacy layouts, read as distributed lines."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from canopy.operators.ordered import running_sum
from canopy.schemas import TELEMETRY
from canopy.session import cut_lineage
from canopy.sources.text import numbered_lines, read_lines

# Fixed values of the subtitle formats: a clock time, a number, and what stands between words.
CLOCK = r"\d{2}:\d{2}:\d{2}[.,]\d{3}"
NUMBER = r"[+-]?\d+(?:\.\d+)?"
SEPARATORS = r"[,;\s]+"
# A block is words, some of which are ``name: number`` or ``name = number`` readings.
READING = rf"([a-z][a-z_]*)\s*[:=]\s*({NUMBER})"
# Names of readings in the subtitle formats, by the column they fill. A reading
# counts for a name that its own name ends with.
NAMES = {
    "counted": ("framecnt", "frame", "frame_idx"),
    "named_lat": ("lat", "latitude"),
    "named_lon": ("lon", "longitude"),
    "rel_alt": ("rel_alt", "relalt"),
    "abs_alt": ("abs_alt", "absalt"),
    "any_alt": ("alt",),
    "focal_len": ("focal_len",),
    "dzoom_ratio": ("dzoom_ratio",),
    "gb_yaw": ("gb_yaw",),
    "gb_pitch": ("gb_pitch",),
    "gb_roll": ("gb_roll",),
}
FIELDS = ["frame", "lat", "lon", "alt", "utc", "rel_alt", "abs_alt", "focal_len", "dzoom_ratio", "gb_yaw", "gb_pitch", "gb_roll"]

# Lines per bucket where lines of one file are put in order.
LINES_PER_CELL = 65536


def _readings(text: Column) -> Column:
    """All readings of a block in order, as (name, number) with names in lower case."""
    plain = F.regexp_replace(F.lower(text), "(rel|abs)\\s+alt", "$1_alt")
    names = F.regexp_extract_all(plain, F.lit(READING), F.lit(1))
    numbers = F.regexp_extract_all(plain, F.lit(READING), F.lit(2))
    return F.zip_with(names, numbers, lambda n, v: F.struct(n.alias("name"), v.cast("double").alias("number")))


def _reading(found: Column, names: tuple[str, ...]) -> Column:
    """The first reading under any of the names; NULL without one."""
    own = F.filter(found, lambda r: functools.reduce(lambda a, b: a | b, [r["name"].endswith(n) for n in names]))
    return F.get(own, 0)["number"]


def _position(text: Column) -> Column:
    """The first two words next to each other of which one ends and the other begins with a decimal number, as a struct."""
    words = F.split(text, SEPARATORS)
    number = lambda w, at: F.regexp_extract(w, at.format(NUMBER), 1)
    decimal = lambda v: F.when(v.contains("."), v)
    rest = F.greatest(F.size(words) - 1, F.lit(0))
    here = F.transform(F.slice(words, F.lit(1), rest), lambda w: decimal(number(w, "({})$")))
    there = F.transform(F.slice(words, F.lit(2), rest), lambda w: decimal(number(w, "^({})")))
    both = F.zip_with(here, there, lambda a, b: F.struct(a.try_cast("double").alias("lat"), b.try_cast("double").alias("lon")))
    return F.get(F.filter(both, lambda p: p["lat"].isNotNull() & p["lon"].isNotNull()), 0)


def _start(text: Column) -> Column:
    """The clock time before the first arrow that stands between two clock times."""
    ends = F.split(text, "\\s*-->\\s*")
    here, there = F.get(ends, 0), F.get(ends, 1)
    start = F.regexp_extract(here, f"({CLOCK})$", 1)
    return F.when((start != "") & there.rlike(f"^{CLOCK}"), F.translate(start, ",", "."))


def clock_seconds(clock: Column) -> Column:
    """``hh:mm:ss.mmm`` as seconds."""
    part = lambda i: F.get(F.split(clock, ":"), i).cast("double")
    return part(0) * 3600 + part(1) * 60 + part(2)


def subtitle_blocks(lines: DataFrame) -> DataFrame:
    """``file, block, text``: the non-empty lines between blank lines, joined by spaces.

    Block numbers come from a two-level running count of blank lines, so one long
    file is spread over tasks; a block itself is a handful of lines.
    """
    numbered = numbered_lines(lines)
    blank = F.trim("line") == ""
    cell = F.floor(F.col("line_no") / LINES_PER_CELL)
    counted = running_sum(numbered, ["file"], ["line_no"], F.when(blank, 1).otherwise(0), "block", cell)
    rows = counted.filter(F.trim("line") != "")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda p: p["line"]), " ")
    return rows.groupBy("file", "block").agg(joined.alias("text"))


def parse_subtitle_blocks(blocks: DataFrame) -> DataFrame:
    """Telemetry of blocks that carry a position; a later block wins on the same frame.

    Frame numbers come from the block's counter, else from the running number of
    accepted blocks without one.
    """
    text = F.col("text")
    raw = blocks.select("file", "block", _start(text).alias("utc"), _position(text).alias("pair"), _readings(text).alias("found"))
    raw = raw.select(
        "file", "block", "utc", F.col("pair.lat").alias("pair_lat"), F.col("pair.lon").alias("pair_lon"), *[_reading(F.col("found"), names).alias(c) for c, names in NAMES.items()]
    ).withColumn("counted", F.greatest(F.floor("counted").cast("int") - 1, F.when(F.col("counted").isNotNull(), 0)))
    # Read by what follows twice and filtered by what was parsed, so parsed once.
    raw = cut_lineage(raw)
    named = F.col("named_lat").isNotNull() & F.col("named_lon").isNotNull()
    raw = raw.withColumn("lat", F.when(named, F.col("named_lat")).otherwise(F.col("pair_lat"))).withColumn(
        "lon", F.when(named, F.col("named_lon")).otherwise(F.col("pair_lon"))
    )
    alone = F.col("rel_alt").isNull() & F.col("abs_alt").isNull()
    raw = raw.withColumn("rel_alt", F.when(alone, F.col("any_alt")).otherwise(F.col("rel_alt"))).withColumn(
        "alt", F.coalesce("rel_alt", "abs_alt")
    )
    accepted = raw.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    free = F.when(F.col("counted").isNull(), 1).otherwise(0)
    numbered = running_sum(accepted, ["file"], ["block"], free, "__free", F.floor(F.col("block") / LINES_PER_CELL))
    numbered = numbered.withColumn("frame", F.coalesce("counted", (F.col("__free") - 1).cast("int")))
    rest = [c for c in FIELDS if c != "frame"]
    return (
        numbered.groupBy("file", "frame").agg(F.max_by(F.struct(*rest), "block").alias("s")).select("file", "frame", "s.*")
        .select("file", *FIELDS)
    )


def parse_srt(lines: DataFrame) -> DataFrame:
    """Subtitle telemetry of every file of ``lines`` (see ``read_lines``)."""
    return parse_subtitle_blocks(subtitle_blocks(lines))


def as_telemetry(parsed: DataFrame, video: Column | None = None) -> DataFrame:
    """``parse_srt`` rows in the shape of ``TELEMETRY``, as the telemetry operators take them.

    The video is the file's name without its ending unless ``video`` says otherwise; ``ts`` is
    the time code in seconds.
    """
    stem = F.regexp_extract("file", "([^/]*?)(?:[.][^./]*)?$", 1)
    rows = parsed.withColumn("video_id", stem if video is None else video).withColumn("ts", clock_seconds(F.col("utc")))
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TELEMETRY])


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    return parse_srt(read_lines(spark, path, "*.[sS][rR][tT]"))


# --- legacy layouts ----------------------------------------------------------

TIME_LINE = r"^(\d+):(\d+):(\d+),(\d+)"


def legacy_layouts(numbered: DataFrame, probe: int = 20) -> DataFrame:
    """Layout per file from its first lines: 1 ``GPS``, 3 ``latitude`` with ``gb_yaw``, 2 ``latitude``, 0 unknown."""
    line = F.col("line")
    head = numbered.withColumn("__head", F.col("line_no") < probe)
    any_of = lambda c: F.max(F.when(F.col("__head") & c, 1).otherwise(0))
    seen = head.groupBy("file").agg(
        any_of(line.contains("GPS")).alias("gps"), any_of(line.contains("latitude") & line.contains("gb_yaw")).alias("yaw"),
        any_of(line.contains("latitude")).alias("lat"),
    )
    layout = F.when(F.col("gps") == 1, 1).when(F.col("yaw") == 1, 3).when(F.col("lat") == 1, 2).otherwise(0)
    return seen.select("file", layout.alias("layout"))


def parse_srt_legacy(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``file, line_no, layout, lat, lon, alt, ts`` of the three older layouts, and the files of none.

    The time code stands 2, 4 or 3 lines above the coordinates. Each line offers
    itself to the line it would time, so the pairing is an equi-join on line numbers.
    """
    numbered = numbered_lines(lines)
    layouts = legacy_layouts(numbered)
    tagged = numbered.join(layouts.filter("layout > 0"), "file")
    line, layout = F.col("line"), F.col("layout")
    marked = F.when(layout == 1, line.contains("GPS")).otherwise(line.contains("latitude"))
    # Values by position once separators are gone.
    gps = F.split(line, r"[() ,:\n]")
    at2 = F.filter(F.split(line, r"[() ,\n\[\]]"), lambda p: p != "")
    at3 = F.filter(F.split(F.translate(line, ",", ""), r"[() ,\n\[\]]"), lambda p: p != "")
    value = lambda arr, i: F.get(arr, i).try_cast("double")
    pick = lambda i1, i2, i3: (
        F.when(layout == 1, F.translate(F.get(gps, i1), "M", "").try_cast("double"))
        .when(layout == 2, value(at2, i2)).otherwise(value(at3, i3))
    )
    offset = F.when(layout == 1, 2).when(layout == 2, 4).otherwise(3)
    coords = tagged.filter(marked).select(
        "file", "line_no", "layout", pick(1, 1, 5).alias("lat"), pick(2, 3, 7).alias("lon"), pick(6, 5, 9).alias("alt")
    )
    part = lambda i: F.regexp_extract(line, TIME_LINE, i).try_cast("int")
    seconds = part(1) * 3600 + part(2) * 60 + part(3) + part(4) / 1000
    times = tagged.filter(line.rlike(TIME_LINE)).select("file", (F.col("line_no") + offset).alias("line_no"), seconds.alias("ts"))
    rejects = layouts.filter("layout = 0").select("file")
    return coords.join(times, ["file", "line_no"], "left"), rejects


def read_srt_legacy(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_srt_legacy(read_lines(spark, path, "*.[sS][rR][tT]"))
