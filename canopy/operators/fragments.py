"""Joining fragments of one animal: candidates, greedy matching, relabelling."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from canopy.functions import geometry as G
from canopy.operators.folds import fold_sorted, independent_parts
from canopy.session import shared

VIDEO = "video_id"


def fragment_ends(det: DataFrame) -> DataFrame:
    """Per entity: first and last frame, positions there, drone-relative offsets, main class name."""
    order = F.struct("frame", "det_id")
    has_rel = F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("lat_drone").isNotNull() & F.col("lon_drone").isNotNull()
    rel = F.when(has_rel, G.local_offset_m("lat", "lon", "lat_drone", "lon_drone"))
    at = F.struct("lat", "lon")
    base = det.filter(F.col("entity_id").isNotNull()).withColumn("__rel", rel)
    ends = base.groupBy(VIDEO, "entity_id").agg(
        F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"),
        F.min_by(at, order).alias("start_abs"), F.max_by(at, order).alias("end_abs"),
        F.min_by("__rel", F.when(has_rel, order)).alias("start_rel"),
        F.max_by("__rel", F.when(has_rel, order)).alias("end_rel"),
    )
    votes = base.groupBy(VIDEO, "entity_id", F.coalesce("name", F.lit("")).alias("name")).agg(
        F.count(F.lit(1)).alias("n"), F.min(order).alias("__o")
    )
    # Most frequent name; the one seen first on a tie.
    main = votes.groupBy(VIDEO, "entity_id").agg(F.min_by("name", F.struct((-F.col("n")).alias("n"), "__o")).alias("name"))
    return ends.join(main, [VIDEO, "entity_id"])


def fragment_candidates(
    ends: DataFrame, fps: float = 30.0, max_gap_frames: int = 220, base_radius_m: float = 10.0, max_speed_mps: float = 5.0
) -> DataFrame:
    """Pairs where one fragment may continue as another.

    Joined on video, a stretch of frames and a ground cell, each twice as wide as fragments may lie
    apart, so only neighbours in time and place ever meet. One side goes to the cells that its reach
    touches, two along an axis at most, the other side to its own.
    """
    ends = shared(ends)  # one row per fragment, met from four sides below
    rate = fps if fps > 0 else 1.0
    reach = base_radius_m + max_speed_mps * max_gap_frames / rate
    src = ends.select(
        VIDEO, F.col("entity_id").alias("src"), "end_frame", F.col("name").alias("src_name"),
        F.col("end_rel").alias("s_rel"), F.col("end_abs").alias("s_abs"),
    )
    dst = ends.select(
        VIDEO, F.col("entity_id").alias("dst"), "start_frame", F.col("name").alias("dst_name"),
        F.col("start_rel").alias("d_rel"), F.col("start_abs").alias("d_abs"),
    )
    far = reach * (1 + 1e-9) + 1e-6  # not cut short by rounding
    cell = lambda c, width: F.floor(c / F.lit(2.0 * width))
    touched = lambda low, high, width: F.explode(F.sequence(cell(low, width), cell(high, width)))
    around = lambda c, width: touched(c - F.lit(width), c + F.lit(width), width)
    later = touched(F.col("end_frame"), F.col("end_frame") + max_gap_frames, max_gap_frames)
    earlier = touched(F.col("start_frame") - max_gap_frames, F.col("start_frame"), max_gap_frames)

    both_rel = (
        src.filter("s_rel IS NOT NULL").withColumn("__tb", later)
        .withColumn("__cx", around(F.col("s_rel.east"), far)).withColumn("__cy", around(F.col("s_rel.north"), far))
        .join(
            dst.filter("d_rel IS NOT NULL").withColumn("__tb", cell(F.col("start_frame"), max_gap_frames))
            .withColumn("__cx", cell(F.col("d_rel.east"), far)).withColumn("__cy", cell(F.col("d_rel.north"), far)),
            [VIDEO, "__tb", "__cx", "__cy"],
        )
        .withColumn("distance_m", F.sqrt(
            F.pow(F.col("s_rel.east") - F.col("d_rel.east"), F.lit(2.0)) + F.pow(F.col("s_rel.north") - F.col("d_rel.north"), F.lit(2.0))
        ))
    )
    # By absolute position when either side has no drone offset: latitude bands only,
    # a metre of longitude changes with latitude. The side without one goes to the other's cells.
    gap_deg = far / 111_000.0
    s_abs = src.filter("s_abs.lat IS NOT NULL AND s_abs.lon IS NOT NULL")
    d_abs = dst.filter("d_abs.lat IS NOT NULL AND d_abs.lon IS NOT NULL")
    s_lat, d_lat = F.col("s_abs.lat"), F.col("d_abs.lat")
    from_free = s_abs.filter("s_rel IS NULL").withColumn("__tb", later).withColumn("__cy", around(s_lat, gap_deg)).join(
        d_abs.withColumn("__tb", cell(F.col("start_frame"), max_gap_frames)).withColumn("__cy", cell(d_lat, gap_deg)), [VIDEO, "__tb", "__cy"]
    )
    to_free = s_abs.filter("s_rel IS NOT NULL").withColumn("__tb", cell(F.col("end_frame"), max_gap_frames)).withColumn("__cy", cell(s_lat, gap_deg)).join(
        d_abs.filter("d_rel IS NULL").withColumn("__tb", earlier).withColumn("__cy", around(d_lat, gap_deg)), [VIDEO, "__tb", "__cy"]
    )
    one_abs = from_free.unionByName(to_free).withColumn(
        "distance_m", G.haversine_m("s_abs.lat", "s_abs.lon", "d_abs.lat", "d_abs.lon")
    )
    cols = [VIDEO, "src", "dst", "end_frame", "start_frame", "src_name", "dst_name", "distance_m"]
    pairs = both_rel.select(*cols).unionByName(one_abs.select(*cols))
    gap = F.col("start_frame") - F.col("end_frame")
    named = (F.col("src_name") != "") & (F.col("dst_name") != "") & (F.col("src_name") != F.col("dst_name"))
    allowed = base_radius_m + max_speed_mps * gap / rate
    return (
        pairs.filter((F.col("src") != F.col("dst")) & (gap > 0) & (gap <= max_gap_frames) & ~named)
        .withColumn("allowed_m", allowed)
        .filter(F.col("distance_m") <= F.col("allowed_m"))
        .withColumn("score", F.col("distance_m") / F.greatest(F.col("allowed_m"), F.lit(1e-6)))
        .select(VIDEO, "src", "dst", "end_frame", "start_frame", "distance_m", "allowed_m", "score")
    )


def _link_step():
    followed, preceded = set(), set()

    def step(src, dst) -> tuple[bool]:
        if src in followed or dst in preceded:
            return (False,)
        followed.add(src)
        preceded.add(dst)
        return (True,)

    return step


def greedy_links(candidates: DataFrame) -> DataFrame:
    """One successor and one predecessor per fragment, best scores first.

    Edges compete only when they share a source or a target, and then their time
    spans touch; pauses between spans cut the edges into parts. Each part is one ordered
    pass that holds the fragments linked so far.
    """
    candidates = shared(candidates.select(VIDEO, "src", "dst", "end_frame", "start_frame", "distance_m", "score"))  # read twice
    axes = [("end_frame", "start_frame", 0.0, 256.0)]
    parts = independent_parts(candidates, [VIDEO], axes, "__part")
    order = [F.col(c) for c in ("score", "distance_m", "src", "dst")]
    folded = fold_sorted(parts, [VIDEO, "__part"], order, ["src", "dst"], "__won boolean", _link_step)
    return folded.filter("__won").select(VIDEO, "src", "dst", "end_frame")


def _chain_step():
    heads: dict[int, int] = {}

    def step(src, dst) -> tuple[int]:
        head = heads.pop(src, src)  # a fragment has one link out of it at most
        heads[dst] = head
        return (head,)

    return step


def chain_heads(links: DataFrame, frames: int = 1 << 16) -> DataFrame:
    """``entity_id -> merged_id``, the earliest fragment of its chain, for linked fragments.

    Time runs along links, so a pass in order of time knows a link's chain from its source. Links
    are followed inside stretches of ``frames`` first, on all tasks; what remains of a stretch is
    one link for each chain in it, from the chain's head there to its last fragment, and only
    these are followed through the video. Building the frame runs no job.
    """
    order = [F.col("end_frame"), F.col("src")]
    cut = links.withColumn("__at", F.floor(F.col("end_frame") / frames))
    inner = shared(fold_sorted(cut, [VIDEO, "__at"], order, ["src", "dst"], "__head long", _chain_step))
    last = F.max_by(F.struct("dst", "end_frame"), F.struct("end_frame", "src")).alias("e")
    chains = inner.groupBy(VIDEO, "__at", "__head").agg(last, F.min("end_frame").alias("__from"))
    chains = chains.select(VIDEO, "__at", "__head", F.col("__head").alias("src"), F.col("e.dst").alias("dst"), "__from")
    outer = fold_sorted(chains, [VIDEO], [F.col("__at"), F.col("__from"), F.col("src")], ["src", "dst"], "merged_id long", _chain_step)
    found = outer.select(F.struct(VIDEO, "__at", "__head").alias("__chain"), "merged_id")
    inner = inner.withColumn("__chain", F.struct(VIDEO, "__at", "__head"))
    return inner.join(found, "__chain").select(VIDEO, F.col("dst").alias("entity_id"), "merged_id")


def _compat_step():
    """Marks kept on chain representatives instead of fragments, as the reference does; links high to low."""
    above: dict[int, int] = {}
    followed, preceded = set(), set()

    def top(n: int) -> int:
        while n in above:
            n = above[n]
        return n

    def step(src, dst) -> tuple:
        a, b = top(src), top(dst)
        if a == b or a in followed or b in preceded:
            return (None, None)
        low, high = sorted((a, b))
        above[high] = low
        followed.add(low)
        preceded.add(high)
        return (high, low)

    return step


def _root_step():
    roots: dict[int, int] = {}

    def step(low, high) -> tuple[int]:
        roots[high] = roots.get(low, low)  # a lower number's own link came before
        return (roots[high],)

    return step


def compat_heads(candidates: DataFrame) -> DataFrame:
    """``entity_id -> merged_id`` by the order-dependent chain rule.

    Edges act on one another through fragments they share, however long a fragment lives. So an
    edge spans the frames that all edges of its two fragments span, and pauses between spans cut
    the edges into parts; each part is one ordered pass, and no video is held as a frame.
    """
    candidates = shared(candidates)
    end = lambda entity, at: F.struct(F.struct(VIDEO, F.col(entity).alias("entity")).alias("e"), F.col(at).alias("at"))
    ends = candidates.select(F.inline(F.array(end("src", "end_frame"), end("dst", "start_frame"))))
    life = ends.groupBy("e").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    edges = candidates
    for c in ("src", "dst"):
        side = life.select(F.col("e").alias("__e"), F.col("low").alias(f"__low_{c}"), F.col("high").alias(f"__high_{c}"))
        edges = edges.withColumn("__e", F.struct(VIDEO, F.col(c).alias("entity"))).join(side, "__e").drop("__e")
    edges = edges.withColumn("__low", F.least("__low_src", "__low_dst")).withColumn("__high", F.greatest("__high_src", "__high_dst"))
    parts = independent_parts(edges, [VIDEO], [("__low", "__high", 0.0, 256.0)], "__part")
    order = [F.col(c) for c in ("score", "distance_m", "src", "dst")]
    folded = fold_sorted(parts, [VIDEO, "__part"], order, ["src", "dst"], "entity_id long, __onto long", _compat_step)
    links = folded.filter("entity_id IS NOT NULL").select(VIDEO, "__part", "entity_id", "__onto")
    found = fold_sorted(links, [VIDEO, "__part"], [F.col("entity_id")], ["__onto", "entity_id"], "merged_id long", _root_step)
    return found.select(VIDEO, "entity_id", "merged_id")


def merge_fragments(det: DataFrame, candidates: DataFrame, compat: bool = False) -> DataFrame:
    """All detections relabelled to the earliest fragment of their chain, also in ``track_id``.

    ``compat`` reproduces the order-dependent chain rule of the reference.
    """
    heads = compat_heads(candidates) if compat else chain_heads(greedy_links(candidates))
    merged = det.join(heads, [VIDEO, "entity_id"], "left")
    merged = merged.withColumn("entity_id", F.coalesce("merged_id", "entity_id")).drop("merged_id")
    return merged.withColumn("track_id", F.col("entity_id")).select(*dict.fromkeys([*det.columns, "track_id"]))
