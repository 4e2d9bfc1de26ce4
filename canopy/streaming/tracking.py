"""Detections as streams: clusters with carried state, telemetry joins, track statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from canopy.constants import METERS_PER_DEGREE
from canopy.operators.folds import plain
from canopy.operators.matching import Cluster, ClusterBook, ClusterRules

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

SUMMARY = (
    "video_id string, cluster_id long, frames long, first_frame long, last_frame long, mean_conf double, "
    "max_conf double, lat double, lon double, track_ids array<long>, closed boolean"
)

# Fields of the state: live clusters, and rows that wait for their frame.
LIVE = {
    "number": "long", "first_frame": "long", "last_frame": "long", "hits": "long", "weight": "double", "wx": "double", "wy": "double",
    "sum_conf": "double", "max_conf": "double", "tracks": "array<long>",
}
WAITING = {
    "frame": "long", "conf": "double", "x1": "double", "y1": "double", "det_id": "long", "lat": "double", "lon": "double", "track": "string",
}
SPAN = 256  # frames whose rows wait together


class ClusterStream(StatefulProcessor):
    """The batch matcher's rules on a stream keyed by video.

    Rows wait in state until the watermark has passed their frame, so frames are matched whole and
    in order however they come. Live clusters are the other state. A cluster that can no longer
    match is emitted once as closed and dropped; touched ones are emitted as they stand. A video
    has one timer, for the next frame that becomes whole or the next cluster that closes.
    """

    def __init__(self, rules: ClusterRules, fps: float, start: float):
        self.rules, self.fps, self.start = rules, fps, start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # A call for each row or cluster would cost more than the matching: live clusters are one
        # value field by field, rows one for ``SPAN`` frames.
        self.live = handle.getValueState("live", ", ".join(f"{f} array<{k}>" for f, k in LIVE.items()))
        # Rows field by field; a missing track is an empty string.
        self.waiting = handle.getMapState("waiting", "span long", ", ".join(f"{f} array<{k}>" for f, k in WAITING.items()))
        self.meta = handle.getValueState("meta", "lat double, lon double, next_number long")
        self.timer = handle.getValueState("timer", "at long")

    def _load(self) -> tuple[ClusterBook, tuple[float, float] | None]:
        held = zip(*self.live.get()) if self.live.exists() else ()
        clusters = [
            Cluster(int(n), int(first), int(last), int(hits), weight, wx, wy, sum_conf, max_conf, [int(t) for t in tracks])
            for n, first, last, hits, weight, wx, wy, sum_conf, max_conf, tracks in held
        ]
        # The order of creation decides ties, as in the batch matcher.
        clusters.sort(key=lambda c: c.number)
        meta = self.meta.get() if self.meta.exists() else None
        return ClusterBook(self.rules, clusters, int(meta[2]) if meta else 1), (meta[0], meta[1]) if meta else None

    def _row(self, video: str, c: Cluster, origin: tuple[float, float], closed: bool) -> tuple:
        per_lon = METERS_PER_DEGREE * math.cos(math.radians(origin[0]))
        lat = origin[0] + c.y / METERS_PER_DEGREE
        lon = origin[1] + (c.x / per_lon if per_lon else 0.0)
        return (
            video, c.number, c.hits, c.first_frame, c.last_frame, c.sum_conf / c.hits, c.max_conf, lat, lon,
            sorted(c.tracks), closed,
        )

    def _emit(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            names = [p.strip().split(" ")[0] for p in SUMMARY.split(", ")]
            yield pd.DataFrame(rows, columns=names)

    def _frame_ms(self, frame: int) -> int:
        """The first watermark at which no row of the frame can come any more."""
        return math.ceil((self.start + frame / self.fps) * 1000 - 1e-6)

    def _wait(self, rows: list[tuple]) -> None:
        """Put rows into the spans of their frames."""
        spans: dict[int, list[tuple]] = {}
        for r in rows:
            spans.setdefault(r[0] // SPAN, []).append(r)
        for span, new in spans.items():
            key = (span,)
            held = self.waiting.getValue(key) if self.waiting.containsKey(key) else [()] * len(WAITING)
            self.waiting.updateValue(key, tuple([*h, *n] for h, n in zip(held, zip(*new))))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        located, number = [], lambda v: math.nan if v is None else float(v)
        for pdf in rows:
            columns = [plain(pdf[c]) for c in ("frame", "conf", "x1", "y1", "det_id", "lat", "lon", "track_id")]
            located += [
                (int(frame), float(conf or 0.0), number(x1), number(y1), int(i), lat, lon, "" if track is None else str(int(track)))
                for frame, conf, x1, y1, i, lat, lon, track in zip(*columns) if None not in (frame, lat, lon)
            ]
        self._wait(located)
        yield from self._advance(key[0], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()  # it has fired
        yield from self._advance(key[0], timerValues.getCurrentWatermarkInMs())

    def _advance(self, video: str, watermark: int) -> Iterator[pd.DataFrame]:
        """Match the frames that are whole, close what has been left behind, and set the timer."""
        whole = math.floor((watermark / 1000 - self.start) * self.fps + 1e-6)
        book, origin = self._load()
        touched: dict[int, Cluster] = {}
        closed: list[Cluster] = []
        later: list[int] = []
        for span in sorted(int(k[0]) for k in self.waiting.keys()):
            if span * SPAN > whole:
                later.append(span * SPAN)
                break
            # By frame, and in a frame the most confident first, as in a batch.
            rows = sorted(zip(*self.waiting.getValue((span,))), key=lambda r: (r[0], -r[1], *r[2:5]))
            ready = [r for r in rows if r[0] <= whole]
            for frame, frame_rows in groupby(ready, key=itemgetter(0)):
                closed += book.retire(frame)
                for _, conf, x1, y1, _, lat, lon, track in frame_rows:
                    if origin is None:
                        origin = (lat, lon)
                    x = (lon - origin[1]) * METERS_PER_DEGREE * math.cos(math.radians(origin[0]))
                    y = (lat - origin[0]) * METERS_PER_DEGREE
                    c = book.place(frame, x, y, conf, int(track) if track else None)
                    touched[c.number] = c
            if len(ready) == len(rows):
                self.waiting.removeKey((span,))
            else:
                later.append(rows[len(ready)][0])
                if ready:
                    self.waiting.updateValue((span,), tuple(list(c) for c in zip(*rows[len(ready):])))
        closed += book.retire(whole)
        gone = {c.number for c in closed}
        if touched or closed:
            states = [c.to_state() for c in book.live]
            if states:
                self.live.update(tuple([s[f] for s in states] for f in LIVE))
            else:
                self.live.clear()
        if origin is not None:
            self.meta.update((origin[0], origin[1], book.next_number))
        self._set_timer(later[:1] + [c.last_frame + self.rules.max_idle_frames + 1 for c in book.live])
        yield from self._emit(
            [self._row(video, c, origin, True) for c in closed]
            + [self._row(video, c, origin, False) for n, c in touched.items() if n not in gone]
        )

    def _set_timer(self, frames: list[int]) -> None:
        at = self._frame_ms(min(frames)) if frames else None
        old = int(self.timer.get()[0]) if self.timer.exists() else None
        if at == old:
            return
        if old is not None:
            self.handle.deleteTimer(old)
            self.timer.clear()
        if at is not None:
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def close(self) -> None:
        pass


def stream_clusters(
    detections: DataFrame, rules: ClusterRules = ClusterRules(), fps: float = 30.0, lateness: str = "10 seconds",
    start: float = 0.0,
) -> DataFrame:
    """Cluster summaries from a stream of located detections with an event time ``ts``
    that is the frame's time (``start + frame / fps`` seconds).

    Rows may come in any order within ``lateness``; a frame is matched when the watermark has
    passed it, so the last ``lateness`` of a stream waits for what comes next. The result is that
    of the batch operator on the rows that were not later than that. The session must keep
    its state in ``STATE_STORE`` (``spark.sql.streaming.stateStore.providerClass``)."""
    return (
        detections.withWatermark("ts", lateness).groupBy("video_id")
        .transformWithStateInPandas(ClusterStream(rules, fps, start), SUMMARY, outputMode="Update", timeMode="EventTime")
    )


def stream_attach_telemetry(
    detections: DataFrame, telemetry: DataFrame, lateness: str = "10 seconds", bound: str = "10 seconds"
) -> DataFrame:
    """Detections left-joined to the telemetry of their frame, both streams with an event time.

    A frame has one telemetry row, the first to come, as in the batch operator; detections
    without one are given out when the watermark has passed them.
    """
    d = detections.withWatermark("ts", lateness).alias("d")
    renamed = telemetry.select(*[F.col(c).alias(f"t_{c}") for c in telemetry.columns]).withWatermark("t_ts", lateness)
    renamed = renamed.dropDuplicatesWithinWatermark(["t_video_id", "t_frame"])
    on = (
        (F.col("d.video_id") == F.col("t_video_id")) & (F.col("d.frame") == F.col("t_frame"))
        & (F.col("t_ts") >= F.col("d.ts") - F.expr(f"INTERVAL {bound}"))
        & (F.col("t_ts") <= F.col("d.ts") + F.expr(f"INTERVAL {bound}"))
    )
    return d.join(renamed, on, "leftOuter").drop("t_video_id", "t_frame")


def stream_track_stats(detections: DataFrame, window: str = "10 seconds", lateness: str = "10 seconds") -> DataFrame:
    """Count and confidence sums per track and window, ready to be added up over windows."""
    return (
        detections.withWatermark("ts", lateness)
        .groupBy(F.window("ts", window).alias("window"), "video_id", "track_id")
        .agg(F.count(F.lit(1)).alias("frames"), F.avg("conf").alias("mean_conf"))
        .select("window.start", "video_id", "track_id", "frames", "mean_conf")
    )
