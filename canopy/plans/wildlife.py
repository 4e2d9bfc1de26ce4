"""From detections and telemetry to confirmed animals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from canopy.operators import fragments as Fr, telemetry as Te, tracking as Tr
from canopy.session import passing


@dataclass(frozen=True)
class WildlifeParams:
    width: int = 640
    height: int = 512
    fps: float = 30.0
    vid_stride: int = 1
    min_detection_conf: float = 0.35
    cluster_radius_m: float = 5.0
    cluster_idle_frames: int = 120
    cluster_min_hits: int = 3
    cluster_freeze_after: int = 30
    cluster_reassoc_m: float = 30.0
    min_track_frames: int = 3
    min_track_conf: float = 0.5
    allow_no_ground: bool = False
    entity_gap_frames: int = 300
    entity_radius_m: float = 25.0
    entity_max_speed_mps: float = 8.0
    merge_gap_frames: int = 220
    merge_base_radius_m: float = 10.0
    merge_speed_mps: float = 5.0
    class_switch_margin: float = 1.5
    hfov: float | None = None
    vfov: float | None = None
    ground_alt: float = 0.0


def wildlife(
    detections: DataFrame,
    telemetry: DataFrame,
    params: WildlifeParams = WildlifeParams(),
    class_names: Mapping[int, str] | Sequence[str] | None = None,
) -> dict[str, DataFrame]:
    """Tables ``detections`` (confirmed and rejected), ``tracks``, ``clusters`` and ``entities``."""
    p = params
    spark = detections.sparkSession
    det = Te.stride_frames(detections, p.vid_stride)
    # Tables made on the way go as soon as what they lead to is written.
    with passing(spark) as lasting:
        with passing(spark) as for_now:
            voted = Tr.smooth_class(det, "track_id", p.class_switch_margin, class_names=class_names)
            # Overlaps are judged by the raw class, everything after by the track's.
            voted = voted.withColumn("__track_cls", F.col("cls")).withColumn("cls", F.coalesce("cls_original", "cls"))
            voted = for_now(voted.drop("cls_original", "name_original"))
        det = Te.min_confidence(Tr.suppress_overlaps(voted), p.min_detection_conf)
        det = Te.normalize_detection(det.withColumn("cls", F.col("__track_cls")).drop("__track_cls"), class_names)
        geo = telemetry.select(
            "video_id", "frame", "ts", "lat", "lon", "alt", "rel_alt", "abs_alt", "focal_len", "dzoom_ratio",
            "gb_yaw", "gb_pitch", "gb_roll", "utc",
        )
        det = Te.locate_detections(
            Te.attach_telemetry(det.drop("utc"), geo), p.width, p.height, p.hfov, p.vfov, p.ground_alt
        )
        limits = Te.geo_calibration(telemetry, p.cluster_radius_m, p.cluster_reassoc_m, p.cluster_freeze_after).select(
            "video_id", "cluster_freeze_after", "cluster_reassoc_m"
        )
        freeze = F.coalesce("cluster_freeze_after", F.lit(p.cluster_freeze_after))
        det = (
            det.join(limits, "video_id", "left")
            .withColumn("cluster_freeze_after", F.when(freeze > 0, freeze))
            .withColumn("cluster_reassoc_m", F.coalesce("cluster_reassoc_m", F.lit(float(p.cluster_reassoc_m))))
        )
        clustered = Tr.spatial_clusters(
            det, p.cluster_radius_m, p.cluster_idle_frames, p.cluster_min_hits, "cluster_freeze_after", "cluster_reassoc_m"
        ).drop("cluster_freeze_after", "cluster_reassoc_m")
        # Read by the summary and twice by the entities, so written once.
        clustered = lasting(clustered)
    clusters = Tr.cluster_summary(clustered, p.cluster_min_hits)
    with passing(spark) as lasting:
        det = Tr.resolve_entities(
            clustered, max(p.entity_gap_frames, 30), max(p.entity_radius_m, 3.0), p.fps, max(p.entity_max_speed_mps, 0.0)
        )
        det = det.withColumn("track_id_original", F.col("track_id")).withColumn("track_id", F.col("entity_id"))
        det = Tr.dedupe_frame(det)
        det = Tr.smooth_class(det, "entity_id", p.class_switch_margin, 3, class_names)
        det = Tr.confirm_detections(det, p.min_track_frames, p.min_track_conf, p.allow_no_ground, "track_id_original")
        rejected = F.col("status") == "rejected"
        det = det.withColumn("cls_original", F.when(rejected, F.col("cls")).otherwise(F.col("cls_original"))).withColumn(
            "name_original", F.when(rejected, F.col("name")).otherwise(F.col("name_original"))
        )
        # Read by the fragment search and by the relabelling, so written once.
        det = lasting(det)
    confirmed = det.filter(F.col("status") == "confirmed")
    ends = Fr.fragment_ends(confirmed)
    pairs = Fr.fragment_candidates(
        ends, p.fps, max(1, p.merge_gap_frames), max(1.0, p.merge_base_radius_m), max(0.1, p.merge_speed_mps)
    )
    det = Fr.merge_fragments(det, pairs)
    confirmed = det.filter(F.col("status") == "confirmed")
    tracks = Tr.track_summary(confirmed)
    entities = confirmed.groupBy("video_id").agg(F.count_distinct("entity_id").alias("animals"))
    return {
        "detections": det, "tracks": tracks, "clusters": clusters, "entities": entities,
    }
