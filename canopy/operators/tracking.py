"""Clusters, entities, class smoothing, confirmation and summaries of detections."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from canopy.constants import METERS_PER_DEGREE
from canopy.functions import detection as D, geometry as G
from canopy.functions.projection import reproject
from canopy.operators.chunks import fold_in_chunks
from canopy.operators.folds import fold_sorted, independent_parts
from canopy.operators.matching import Cluster, ClusterBook, ClusterRules, EntityBook, EntityRules, MotionBook
from canopy.operators.medoid import medoid
from canopy.operators.ordered import fill, row_numbers
from canopy.operators.telemetry import heading
from canopy.operators.votes import scan_votes
from canopy.session import cut_lineage

VIDEO = "video_id"
# A chunk of one ordered pass is so many times what it reads before itself.
CHUNK = 8
# What names a cluster or entity within a video until it has its number.
ENTRY = ["__part", "__run", "__local"]
# Order of detections within a frame: most confident first, position and id break ties.
RANK = ["x1", "y1", "det_id"]


def confidence() -> Column:
    """Confidence to rank by; a missing one ranks as 0, wherever rows are put in order."""
    c = F.col("conf").cast("double")
    return F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))


def frame_order() -> list[Column]:
    return [F.col("frame"), confidence().desc(), *[F.col(c) for c in RANK]]


def _first_key(prefix: Sequence[str] = ()) -> Column:
    """The same order as one comparable struct."""
    return F.struct(*[F.col(c) for c in prefix], "frame", (-confidence()).alias("neg_conf"), *RANK)


# --- boxes of one frame ------------------------------------------------------

FEW = 64  # boxes held up to which plain numbers are faster than arrays


def _box_step(iou_limit: float, center_px: float):
    """Greedy suppression over a stream of boxes, most confident first; holds the boxes kept.

    Boxes of a frame are few as a rule and compared one by one, those of a crowded one as an array.
    """
    few: list[tuple] = []
    room, count = None, 0

    def meets(r, area, k, k_area) -> bool:
        w, h = min(k[2], r[2]) - max(k[0], r[0]), min(k[3], r[3]) - max(k[1], r[1])
        over = 0.0
        if w > 0 and h > 0:
            inter = w * h
            union = k_area + area - inter
            over = inter / union if inter > 0 and union > 0 else 0.0
        if over >= iou_limit:
            return True
        return over >= 0.35 and k[4] == r[4] and bool(np.hypot((k[0] + k[2] - r[0] - r[2]) / 2, (k[1] + k[3] - r[1] - r[3]) / 2) <= center_px)

    def meets_any(r) -> bool:
        kept = room[:count]
        w = np.clip(np.minimum(kept[:, 2], r[2]) - np.maximum(kept[:, 0], r[0]), 0, None)
        h = np.clip(np.minimum(kept[:, 3], r[3]) - np.maximum(kept[:, 1], r[1]), 0, None)
        inter = w * h
        area = lambda b: np.clip((b[..., 2] - b[..., 0]) * (b[..., 3] - b[..., 1]), 0, None)
        union = area(kept) + area(r) - inter
        over = np.where((inter > 0) & (union > 0), inter / np.where(union > 0, union, 1), 0.0)
        apart = np.hypot((kept[:, 0] + kept[:, 2] - r[0] - r[2]) / 2, (kept[:, 1] + kept[:, 3] - r[1] - r[3]) / 2)
        close = (kept[:, 4] == r[4]) & (apart <= center_px) & (over >= 0.35)
        return bool(((over >= iou_limit) | close).any())

    def step(x1, y1, x2, y2, cls) -> tuple[bool]:
        nonlocal room, count
        r = (x1, y1, x2, y2, cls)
        sound = None not in r and all(v == v for v in r)
        if room is None and sound and count < FEW:
            area = max((x2 - x1) * (y2 - y1), 0.0)
            if any(meets(r, area, k, k_area) for k, k_area in few):
                return (False,)
            few.append((r, area))
            count += 1
            return (True,)
        if room is None:
            room = np.empty((2 * FEW, 5))
            for i, (k, _) in enumerate(few):
                room[i] = k
        r = np.array(r, dtype=float)
        if meets_any(r):
            return (False,)
        if count == len(room):
            room = np.concatenate([room, np.empty_like(room)])
        room[count] = r
        count += 1
        return (True,)

    return step


def suppress_overlaps(det: DataFrame, iou: float = 0.65, center_px: float = 28.0) -> DataFrame:
    """Greedy per frame: a box goes when a kept one overlaps it too much.

    One ordered pass over each frame for all frames; a task holds the boxes kept of one frame.
    """
    order = [confidence().desc(), *[F.col(c) for c in RANK]]
    folded = fold_sorted(
        det, [VIDEO, "frame"], order, ["x1", "y1", "x2", "y2", "cls"], "__keep boolean", lambda: _box_step(iou, center_px)
    )
    return folded.filter("__keep").select(*det.columns)


# --- clusters ----------------------------------------------------------------

class _ClusterSteps:
    """A cluster book as a fold: limits come with the rows, as a video has its own."""

    def __init__(self, rules: ClusterRules, state: str | None):
        told = json.loads(state) if state else {"next": 1, "live": []}
        self.rules, self.book = rules, ClusterBook(rules, [Cluster(**c) for c in told["live"]], told["next"])

    next_number = property(lambda self: self.book.next_number)
    inherited = property(lambda self: self.book.inherited, lambda self, v: setattr(self.book, "inherited", v))
    tied = property(lambda self: self.book.tied, lambda self, v: setattr(self.book, "tied", v))

    def step(self, frame, x, y, conf, track, freeze, reassoc) -> tuple:
        book = self.book
        if book.rules.freeze_after != freeze or book.rules.reassoc_m != reassoc:
            book.rules = replace(self.rules, freeze_after=freeze, reassoc_m=reassoc)
        book.retire(frame)
        c = book.place(frame, x, y, conf, track)
        return c.number, c.hits, c.x, c.y

    def live(self, frame: int) -> list[tuple[int, list]]:
        return [(c.number, [c.last_frame, c.hits, c.weight, c.wx, c.wy, sorted(c.tracks)]) for c in self.book.lasting(frame)]

    def save(self, frame: int) -> str:
        return json.dumps({"next": self.book.next_number, "live": [c.to_state() for c in self.book.lasting(frame)]})


def _number_firsts(
    rows: DataFrame, keys: Sequence[str], group: Sequence[str], out: str, idle: int
) -> DataFrame:
    """Number groups of ``rows`` from 1 per key by their first detection."""
    firsts = rows.groupBy(*keys, *group).agg(F.min(_first_key()).alias("__first")).select(*keys, *group, "__first.*")
    cell = F.floor(F.col("frame") / F.lit(max(idle, 1) * 16)).cast("long")
    return row_numbers(firsts, keys, ["frame", "neg_conf", *RANK], out, cell).select(*keys, *group, out)


def with_number(rows: DataFrame, ids: DataFrame, group: Sequence[str] = tuple(ENTRY)) -> DataFrame:
    """``rows`` with the number of their group; null videos have theirs."""
    own = ids.withColumn("__key", F.struct(VIDEO)).drop(VIDEO)
    return rows.withColumn("__key", F.struct(VIDEO)).join(own, ["__key", *group]).drop("__key")


def spatial_clusters(
    det: DataFrame,
    radius_m: float = 5.0,
    max_idle_frames: int = 120,
    min_hits: int = 3,
    freeze_after: int | str | None = 30,
    reassoc_m: float | str = 30.0,
) -> DataFrame:
    """Detections with ``cluster_id, cluster_hits, cluster_confirmed, cluster_lat, cluster_lon``
    as they stand right after each detection; NULL without a position.

    ``freeze_after`` and ``reassoc_m`` may name columns that hold them per video.

    Stretches that are idle for longer than the limit, or farther apart than any
    matching radius, cannot share a cluster. They are cut apart first, in time, in place, and
    once more in the time of each place; a part without pauses is folded in chunks. So one
    long video spreads over many tasks.
    """
    rules = ClusterRules(radius_m, max_idle_frames, min_hits, reassoc_m=math.inf if isinstance(reassoc_m, str) else reassoc_m)
    limit = lambda v, kind: F.col(v).cast(kind) if isinstance(v, str) else F.lit(v).cast(kind)
    det = cut_lineage(det)
    has = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    placed, missing = det.filter(has), det.filter(~has)
    origin = placed.groupBy(VIDEO).agg(F.min_by(F.struct("lat", "lon"), _first_key()).alias("__o"))
    origin = origin.select(F.struct(VIDEO).alias("__key"), F.col("__o.lat").alias("__olat"), F.col("__o.lon").alias("__olon"))
    local = G.to_local_m("lat", "lon", "__olat", "__olon")
    metric = (
        placed.withColumn("__key", F.struct(VIDEO)).join(origin, "__key").drop("__key").withColumn("__m", local)
        .withColumn("__x", F.col("__m.east")).withColumn("__y", F.col("__m.north")).drop("__m")
        .withColumn("__conf", confidence()).withColumn("__freeze", limit(freeze_after, "long")).withColumn("__reassoc", limit(reassoc_m, "double"))
    )
    axes = [
        ("frame", "frame", float(max_idle_frames), float(max(max_idle_frames, 1))),
        ("__x", "__x", rules.reach, rules.reach),
        ("__y", "__y", rules.reach, rules.reach),
    ]
    parts = independent_parts(metric, [VIDEO], [*axes, axes[0]], "__part")
    warm = 2 * max(max_idle_frames, 1)
    folded = cut_lineage(fold_in_chunks(
        parts, [VIDEO, "__part"], frame_order(), ["frame", "__x", "__y", "__conf", "track_id", "__freeze", "__reassoc"],
        "cluster_hits long, __cx double, __cy double", lambda state: _ClusterSteps(rules, state), CHUNK * warm, warm,
    ))
    ids = _number_firsts(folded, [VIDEO], ENTRY, "cluster_id", max_idle_frames)
    per_lon = METERS_PER_DEGREE * F.cos(F.radians("__olat"))
    done = (
        with_number(folded, ids)
        .withColumn("cluster_confirmed", F.col("cluster_hits") >= min_hits)
        .withColumn("cluster_lat", F.col("__olat") + F.col("__cy") / METERS_PER_DEGREE)
        .withColumn("cluster_lon", F.col("__olon") + F.try_divide(F.col("__cx"), per_lon))
    )
    added = ["cluster_id", "cluster_hits", "cluster_confirmed", "cluster_lat", "cluster_lon"]
    types = {f.name: f.dataType for f in done.schema.fields}
    empty = missing.select("*", *[
        (F.lit(False) if c == "cluster_confirmed" else F.lit(None)).cast(types[c]).alias(c) for c in added
    ])
    return done.select(*det.columns, *added).unionByName(empty)


# --- entities ----------------------------------------------------------------

def resolve_entities(
    det: DataFrame,
    gap_frames: int = 300,
    radius_m: float = 25.0,
    fps: float = 30.0,
    max_speed_mps: float = 8.0,
) -> DataFrame:
    """Detections with a stable ``entity_id`` per video, numbered by first sighting.

    Nothing is remembered past ``gap_frames``, so longer pauses cut a video into
    parts that are resolved in parallel, and a part without pauses is resolved in chunks.
    """
    rules = EntityRules(gap_frames, radius_m, fps, max_speed_mps)
    given = det if "cluster_id" in det.columns else det.withColumn("cluster_id", F.lit(None).cast("long"))
    axes = [("frame", "frame", float(gap_frames), float(max(gap_frames, 1)))]
    parts = independent_parts(given, [VIDEO], axes, "__part")
    warm = 2 * max(gap_frames, 1)
    folded = cut_lineage(fold_in_chunks(
        parts, [VIDEO, "__part"], frame_order(), ["frame", "track_id", "cluster_id", "lat", "lon", "lat_drone", "lon_drone"], "",
        lambda state: EntityBook.restored(rules, state), CHUNK * warm, warm,
    ))
    ids = _number_firsts(folded, [VIDEO], ENTRY, "entity_id", gap_frames)
    return with_number(folded, ids).select(*given.columns, "entity_id")


def dedupe_frame(det: DataFrame) -> DataFrame:
    """One row per entity and frame, the most confident (first on a tie); rows without entity stay."""
    known = det.filter(F.col("entity_id").isNotNull())
    rest = [c for c in det.columns if c not in (VIDEO, "frame", "entity_id")]
    best = (
        known.groupBy(VIDEO, "frame", "entity_id").agg(F.min_by(F.struct(*rest), _first_key()).alias("s"))
        .select(VIDEO, "frame", "entity_id", "s.*").select(*det.columns)
    )
    return best.unionByName(det.filter(F.col("entity_id").isNull()))


# --- classes -----------------------------------------------------------------

def smooth_class(
    det: DataFrame, key: str, margin: float = 1.5, min_hits: int = 1, class_names=None
) -> DataFrame:
    """Class by running evidence per ``key``; the raw class is kept in ``cls_original`` where it differs.

    ``key`` is a column such as ``track_id`` (tracker level) or ``entity_id`` with
    ``min_hits=3``. A long key is scanned in pieces on all tasks. A missing class counts as 0,
    a missing or negative confidence as no evidence.
    """
    known = det.filter(F.col(key).isNotNull())
    folded = scan_votes(
        known, [VIDEO, key], frame_order(), F.floor(F.col("frame") / 1024), F.coalesce(F.col("cls").cast("int"), F.lit(0)),
        F.greatest(confidence(), F.lit(0.0)), max(0.0, margin), min_hits, "__stable",
    )
    out = folded.unionByName(det.filter(F.col(key).isNull()).withColumn("__stable", F.col("cls").cast("int")))
    changed = F.col("__stable") != F.col("cls")
    name = D.class_name("__stable", class_names) if class_names is not None else F.col("__stable").cast("string")
    out = out.withColumn("cls_original", F.when(changed, F.col("cls")))
    if "name" in det.columns:
        out = out.withColumn("name_original", F.when(changed, F.col("name"))).withColumn(
            "name", F.when(changed, name).otherwise(F.col("name"))
        )
    return out.withColumn("cls", F.coalesce("__stable", "cls")).drop("__stable")


# --- confirmation and summaries ----------------------------------------------

def valid_tracks(det: DataFrame, min_frames: int = 3, min_conf: float = 0.5, track: str = "track_id") -> DataFrame:
    stats = det.filter(F.col(track).isNotNull()).groupBy(VIDEO, track).agg(
        F.count(F.lit(1)).alias("frames"), F.avg("conf").alias("mean_conf")
    )
    return stats.filter((F.col("frames") >= max(1, min_frames)) & (F.col("mean_conf") >= min_conf))


def confirm_detections(
    det: DataFrame,
    min_frames: int = 3,
    min_conf: float = 0.5,
    allow_no_ground: bool = False,
    track: str = "track_id",
) -> DataFrame:
    """``status`` and ``reject_reason`` from ground projection, cluster and track evidence."""
    good = valid_tracks(det, min_frames, min_conf, track).select(VIDEO, track, F.lit(True).alias("__valid"))
    m = det.join(good, [VIDEO, track], "left")
    in_cluster = F.coalesce(F.col("cluster_confirmed"), F.lit(False)) & F.col("cluster_id").isNotNull()
    reason = (
        F.when(~F.coalesce(F.col("grounded"), F.lit(False)), None if allow_no_ground else "no_ground_projection")
        .when(in_cluster, None)
        .when(F.col(track).isNull(), "cluster_unconfirmed")
        .when(F.col("__valid"), None)
        .otherwise("track_short_or_low_conf")
    )
    out = m.withColumn("reject_reason", reason.cast("string")).drop("__valid")
    return out.withColumn("status", F.when(F.col("reject_reason").isNull(), "confirmed").otherwise("rejected"))


def cluster_summary(det: DataFrame, min_hits: int = 1) -> DataFrame:
    """Per cluster: size, frames, confidence, last centre, track ids."""
    track = "track_id_original" if "track_id_original" in det.columns else "track_id"
    last = F.struct("frame", "cluster_hits")
    return (
        det.filter(F.col("cluster_id").isNotNull()).groupBy(VIDEO, "cluster_id").agg(
            F.count(F.lit(1)).alias("frames"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"),
            F.avg("conf").alias("mean_conf"), F.max("conf").alias("max_conf"),
            F.max_by("cluster_lat", last).alias("lat"), F.max_by("cluster_lon", last).alias("lon"),
            F.sort_array(F.collect_set(track)).alias("track_ids"),
        ).filter(F.col("frames") >= min_hits)
    )


def track_summary(det: DataFrame) -> DataFrame:
    """Per track: size, frames, confidence, and the fields of its last detection."""
    tail = [c for c in ("cls", "name", "lat", "lon", "alt", "utc") if c in det.columns]
    return det.filter(F.col("track_id").isNotNull()).groupBy(VIDEO, "track_id").agg(
        F.count(F.lit(1)).alias("frames"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"),
        F.avg("conf").alias("mean_conf"), F.max("conf").alias("max_conf"),
        F.max_by(F.struct(*tail), _first_key()).alias("s"),
    ).select(VIDEO, "track_id", "frames", "first_frame", "last_frame", "mean_conf", "max_conf", "s.*")


# --- counting by motion ------------------------------------------------------

def _motion_step(speed: float, limit: float):
    book = MotionBook(speed, limit)
    return lambda north, east, t: (book.place(north, east, t)[0],)


def count_unique_by_motion(
    det: DataFrame,
    telemetry: DataFrame,
    width: int,
    height: int,
    speed: float = 12.0,
    limit: float = 30.0,
    epsg: int = 3346,
) -> DataFrame:
    """Detections with ``entity_id`` from planar position and plausible travel distance.

    Frames whose drone position equals the frame before are left out. An entity can
    only be met within ``limit`` metres of its last place, so places farther apart
    are counted in parallel.
    """
    cell = F.floor(F.col("frame") / 1024)
    facing = heading(telemetry, cell)
    moved = fill(facing, [VIDEO], ["frame"], {"__before": F.struct("lat", "lon")}, inclusive=False, bucket=cell)
    same = F.col("__before").isNotNull() & (F.col("__before.lat") == F.col("lat")) & (F.col("__before.lon") == F.col("lon"))
    used = moved.filter(~same).select(VIDEO, "frame", "ts", "lat", "lon", "rel_alt", "heading")
    planar = reproject(used, "lon", "lat", 4326, epsg).withColumnRenamed("lon", "__e").withColumnRenamed("lat", "__n")
    seen = det.drop("ts", "lat", "lon", "rel_alt").join(planar, [VIDEO, "frame"])
    at = D.locate_by_gsd("x1", "y1", "x2", "y2", "__n", "__e", "rel_alt", "heading", width, height)
    seen = seen.withColumn("__p", at).withColumn("__north", F.col("__p.north")).withColumn("__east", F.col("__p.east"))
    axes = [("__east", "__east", limit, limit), ("__north", "__north", limit, limit)]
    parts = independent_parts(cut_lineage(seen.drop("__p", "__e", "__n")), [VIDEO], axes, "__part")
    folded = cut_lineage(
        fold_sorted(
            parts, [VIDEO, "__part"], frame_order(), ["__north", "__east", "ts"], "__local long",
            lambda: _motion_step(speed, limit),
        )
    )
    ids = _number_firsts(folded, [VIDEO], ["__part", "__local"], "entity_id", 64)
    return (
        with_number(folded, ids, ["__part", "__local"])
        .withColumn("north", F.col("__north")).withColumn("east", F.col("__east"))
        .select(*det.columns, "ts", "north", "east", "entity_id")
    )


def representative_obs(
    obs: DataFrame,
    mode: str,
    center: tuple[float, float] | None = None,
    keys: Sequence[str] = (VIDEO, "entity_id"),
) -> DataFrame:
    """One observation per entity: ``first, last, max_prob, centered, mixed`` or ``medoid``.

    ``obs`` has ``ts, det_id, prob, north, east`` and box columns.
    """
    keys = list(keys)
    row = F.struct(*[c for c in obs.columns if c not in keys])
    early = F.struct(F.col("ts"), F.col("det_id"))
    if mode == "medoid":
        return medoid(obs, keys)
    if mode == "first":
        pick = F.min_by(row, early)
    elif mode == "last":
        pick = F.max_by(row, early)
    else:
        score = F.lit(1.0)
        if mode in ("max_prob", "mixed"):
            score = F.col("prob")
        if mode in ("centered", "mixed"):
            cx, cy = center
            far = F.sqrt(F.lit(float(cx * cx + cy * cy)))
            dx, dy = (F.col("x1") + F.col("x2")) / 2 - cx, (F.col("y1") + F.col("y2")) / 2 - cy
            base = F.sqrt(far)
            # 1 near the centre up to 2 in a corner.
            score = score / (F.log(F.greatest(base, F.sqrt(dx * dx + dy * dy))) / F.log(base))
        elif mode != "max_prob":
            raise ValueError(mode)
        pick = F.min_by(row, F.struct((-score).alias("s"), early.alias("e")))
    return obs.groupBy(*keys).agg(pick.alias("s")).select(*keys, "s.*")
