"""Scene catalogue search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from canopy.constants import BAND_ASSETS, GENERATED_BANDS, INDEX_BANDS

TILE_PATTERN = r"(?:^|_)(T[^_]{5})(?:_|$)"


def meets_polygon(polygon: Sequence[tuple[float, float]], minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """Whether boxes and one given polygon share a point: an edge reaches a box, or a box lies inside."""
    ring = [(float(x), float(y)) for x, y in polygon]
    if len(ring) < 3:
        raise ValueError("a polygon has three corners at least")
    reached, crossings = F.lit(False), F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
        dx, dy = x2 - x1, y2 - y1
        near = (maxx >= min(x1, x2)) & (minx <= max(x1, x2)) & (maxy >= min(y1, y2)) & (miny <= max(y1, y2))
        # The side of the edge's line on which the box's outermost corners lie.
        side = lambda x, y: dx * (y - y1) - dy * (x - x1)
        low = side(maxx if dy > 0 else minx, miny if dx > 0 else maxy)
        high = side(minx if dy > 0 else maxx, maxy if dx > 0 else miny)
        reached |= near & (low <= 0) & (high >= 0)
        if dy:
            ahead = (miny < max(y1, y2)) & (miny >= min(y1, y2)) & (minx < x1 + (miny - y1) * (dx / dy))
            crossings = crossings + ahead.cast("int")
    return reached | (crossings % 2 == 1)


def search_scenes(
    scenes: DataFrame,
    collection: str,
    start: str | None = None,
    end: str | None = None,
    bbox: Sequence[float] | None = None,
    max_cloud: float | None = None,
    mode: str | None = None,
    orbit: str | None = None,
    cloud_inclusive: bool = False,
    polarisations: Sequence[str] = (),
    ordered: bool = True,
    polygon: Sequence[tuple[float, float]] | None = None,
) -> DataFrame:
    """Scenes of a collection by date range, area (box or polygon) and sensor properties.

    Date or area must be given. An ``end`` that is a day takes the whole day. A scene meets a
    polygon where its own box does. ``cloud_inclusive`` and ``polarisations`` are the
    rules of the second catalogue service (``<=``; every polarisation present).
    """
    if start is None and end is None and bbox is None and polygon is None:
        raise ValueError("give a date range or an area")
    if start is not None and end is not None and start > end:
        raise ValueError("start lies after end")
    keep = F.col("collection") == collection
    if start is not None:
        keep &= F.col("datetime") >= F.lit(start).cast("timestamp")
    if end is not None:
        last = F.lit(end).cast("timestamp")
        day = len(end) == len("2000-01-01")
        keep &= (F.col("datetime") < last + F.expr("INTERVAL 1 DAY")) if day else (F.col("datetime") <= last)
    if bbox is not None:
        minx, miny, maxx, maxy = bbox
        keep &= (F.col("bbox.minx") <= maxx) & (F.col("bbox.maxx") >= minx)
        keep &= (F.col("bbox.miny") <= maxy) & (F.col("bbox.maxy") >= miny)
    if polygon is not None:
        keep &= meets_polygon(polygon, *[F.col(f"bbox.{c}") for c in ("minx", "miny", "maxx", "maxy")])
    if max_cloud is not None:
        cloud = F.col("cloud_cover")
        keep &= (cloud <= max_cloud) if cloud_inclusive else (cloud < max_cloud)
    if mode is not None:
        keep &= F.col("instrument_mode") == mode
    if orbit is not None:
        keep &= F.lower("orbit_state") == orbit.lower()
    for p in polarisations:
        keep &= F.array_contains(F.col("polarisations"), p)
    found = scenes.filter(keep)
    return found.orderBy("datetime") if ordered else found


def with_tile_id(scenes: DataFrame, scene_id: str = "scene_id") -> DataFrame:
    """Tile token and UTM zone read from the scene name."""
    tile = F.regexp_extract(scene_id, TILE_PATTERN, 1)
    return scenes.withColumn("tile", F.when(tile != "", tile)).withColumn(
        "utm_zone", F.expr("try_cast(substring(tile, 2, 2) AS INT)")
    )


def filter_tiles(scenes: DataFrame, tiles: Sequence[str] = (), utm_zones: Sequence[int] = ()) -> DataFrame:
    """Scenes of the allowed tiles and zones; an empty list allows all."""
    named = scenes if "tile" in scenes.columns else with_tile_id(scenes)
    if tiles:
        named = named.filter(F.col("tile").isin(*tiles))
    if utm_zones:
        named = named.filter(F.col("utm_zone").isin(*utm_zones))
    return named


def single_tile(scenes: DataFrame, allowed: Sequence[str] = ()) -> DataFrame:
    """Scenes of one tile: the most frequent, or with a list the least frequent allowed."""
    named = scenes if "tile" in scenes.columns else with_tile_id(scenes)
    counts = named.filter(F.col("tile").isNotNull()).groupBy("tile").agg(F.count(F.lit(1)).alias("n"))
    # Only one struct per task travels to the final minimum.
    if allowed:
        best = counts.filter(F.col("tile").isin(*allowed)).agg(F.min(F.struct("n", "tile")).alias("b"))
    else:
        best = counts.agg(F.min(F.struct((-F.col("n")).alias("n"), "tile")).alias("b"))
    return named.filter(F.col("tile") == best.select("b.tile").scalar())


def dedupe_scenes(scenes: DataFrame, order: Sequence[str] = ("datetime",)) -> DataFrame:
    """First scene per id in result order, as a partial aggregate."""
    rest = [c for c in scenes.columns if c != "scene_id"]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("s")
    return scenes.groupBy("scene_id").agg(first).select("scene_id", "s.*").select(*scenes.columns)


def distinct_tiles(scenes: DataFrame) -> DataFrame:
    named = scenes if "tile" in scenes.columns else with_tile_id(scenes)
    return named.select("tile").filter(F.col("tile").isNotNull()).distinct()


def resolve_assets(scenes: DataFrame, bands: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """One row per scene and band with the object key, without scheme and bucket, and the
    scenes and bands that have no such asset."""
    wanted = [b for b in bands if b not in GENERATED_BANDS]
    unknown = [b for b in wanted if b not in BAND_ASSETS]
    if unknown:
        raise ValueError(f"unknown bands {unknown}")
    pairs = [F.struct(F.lit(b).alias("band"), F.lit(BAND_ASSETS[b]).alias("asset_key")) for b in wanted]
    href = F.try_element_at("assets", F.col("asset_key"))["href"]
    asked = scenes.select("*", F.inline(F.array(*pairs))).withColumn("href", href)
    found = asked.filter(F.col("href").isNotNull()).withColumn(
        "object_key", F.regexp_replace("href", r"^[A-Za-z0-9]+://[^/]+/", "")
    )
    return found, asked.filter(F.col("href").isNull()).drop("href")


def required_assets(scenes: DataFrame, indices: Sequence[str]) -> DataFrame:
    """Distinct scene and band pairs the named indices read."""
    unknown = [i for i in indices if i not in INDEX_BANDS]
    if unknown:
        raise ValueError(f"unknown indices {unknown}")
    bands = sorted({b for i in indices for b in INDEX_BANDS[i]})
    literal = F.array(*[F.lit(b) for b in bands])
    return scenes.select("scene_id").distinct().select("scene_id", F.explode(literal).alias("band"))


def season_slices(
    df: DataFrame, ts: str, start_month: int = 4, end_month: int = 9, periods: int = 4
) -> DataFrame:
    """Cut each year's season into ``periods - 1`` equal half-open slices, numbered from 1."""
    year = F.year(ts)

    def edge(month: int) -> Column:
        return F.unix_timestamp(F.make_date(year, F.lit(month), F.lit(1)).cast("timestamp"))

    lo, hi = edge(start_month), edge(end_month)
    at = F.unix_timestamp(F.col(ts).cast("timestamp"))
    slot = F.width_bucket(at.cast("double"), lo.cast("double"), hi.cast("double"), F.lit(periods - 1))
    return (
        df.withColumn("season", year)
        .withColumn("slice", slot.cast("int"))
        .filter(F.col("slice").between(1, periods - 1))
    )
