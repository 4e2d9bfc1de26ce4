"""Sequential identity rules as small state objects, shared by batch and stream."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field

from canopy.constants import EARTH_MEAN_M, METERS_PER_DEGREE


def _known(v) -> bool:
    return v is not None and v == v


def metres_between(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    dp, dl = math.radians(lat2 - lat1) / 2, math.radians(lon2 - lon1) / 2
    a = math.sin(dp) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(dl) ** 2
    return 2 * EARTH_MEAN_M * math.atan2(math.sqrt(a), math.sqrt(max(1e-12, 1 - a)))


def offset_metres(lat: float, lon: float, ref_lat: float, ref_lon: float) -> tuple[float, float]:
    per_lon = METERS_PER_DEGREE * math.cos(math.radians((lat + ref_lat) / 2))
    return (lon - ref_lon) * per_lon, (lat - ref_lat) * METERS_PER_DEGREE


# Fixed values of the identity rules, which ids depend on.
LEAST_TRACK_REACH_M = 12.0
LEAST_FROZEN_REACH_M = 25.0
FOREIGN_SHARE = 0.45
LEAST_REACH_M = 6.0
DRONE_SHARE = 0.9
DRONE_STRETCH = 1.15
SAME_CLUSTER_SHARE = 0.85


@dataclass(frozen=True)
class ClusterRules:
    radius_m: float = 5.0
    max_idle_frames: int = 120
    min_hits: int = 3
    freeze_after: int | None = 30
    reassoc_m: float = 30.0

    @property
    def track_reach(self) -> float:
        return max(2 * self.radius_m, LEAST_TRACK_REACH_M)

    @property
    def frozen_reach(self) -> float:
        return min(self.reassoc_m, max(3 * self.radius_m, LEAST_FROZEN_REACH_M))

    @property
    def reach(self) -> float:
        """No detection joins a cluster whose centre lies farther away."""
        return max(self.radius_m, self.track_reach, self.frozen_reach)


@dataclass
class Cluster:
    number: int
    first_frame: int
    last_frame: int
    hits: int = 0
    weight: float = 0.0
    wx: float = 0.0
    wy: float = 0.0
    sum_conf: float = 0.0
    max_conf: float = 0.0
    tracks: list = field(default_factory=list)

    @property
    def x(self) -> float:
        return self.wx / self.weight

    @property
    def y(self) -> float:
        return self.wy / self.weight

    def distance(self, x: float, y: float) -> float:
        return math.hypot(x - self.x, y - self.y)

    def add(self, frame: int, x: float, y: float, conf: float, track, move: bool) -> None:
        self.last_frame = frame
        self.hits += 1
        self.sum_conf += conf
        self.max_conf = max(self.max_conf, conf)
        if move or self.weight == 0.0:
            w = max(conf, 1e-3)
            self.weight += w
            self.wx += x * w
            self.wy += y * w
        if track is not None and track not in self.tracks:
            self.tracks.append(track)

    def to_state(self) -> dict:
        return asdict(self)


class ClusterBook:
    """Live clusters of one place and time; idle ones leave the book."""

    def __init__(self, rules: ClusterRules, clusters: list[Cluster] | None = None, next_number: int = 1):
        self.rules = rules
        self.live = list(clusters or [])
        self.next_number = next_number
        self.inherited, self.tied = 1, False

    def lasting(self, frame: int) -> list[Cluster]:
        return [c for c in self.live if frame - c.last_frame <= self.rules.max_idle_frames]

    def retire(self, frame: int) -> list[Cluster]:
        """Take out the clusters that can no longer match at ``frame``."""
        idle = self.rules.max_idle_frames
        gone = [c for c in self.live if frame - c.last_frame > idle]
        if gone:
            self.live = [c for c in self.live if frame - c.last_frame <= idle]
        return gone

    def place(self, frame: int, x: float, y: float, conf: float, track) -> Cluster:
        """Cluster of a detection: its track's, the nearest, a frozen one in reach, or a new one."""
        r = self.rules
        near = [(c.distance(x, y), c) for c in self.live]

        def nearest(limit: float, allowed) -> Cluster | None:
            fit = [(d, c) for d, c in near if d <= limit and allowed(d, c)]
            best = min(fit, key=lambda p: p[0], default=None)
            if best and best[1].number < self.inherited:
                self.tied |= any(d == best[0] and c is not best[1] and c.number < self.inherited for d, c in fit)
            return best[1] if best else None

        foreign = lambda c: track is not None and bool(c.tracks) and track not in c.tracks
        frozen = lambda c: r.freeze_after is not None and c.hits >= r.freeze_after
        chosen = nearest(r.track_reach, lambda d, c: track in c.tracks) if track is not None else None
        move = True
        if chosen is None:
            chosen = nearest(r.radius_m, lambda d, c: not (foreign(c) and d > FOREIGN_SHARE * r.radius_m))
        if chosen is None:
            chosen = nearest(r.frozen_reach, lambda d, c: frozen(c) and not foreign(c))
            move = chosen is None
        if chosen is None:
            chosen = Cluster(self.next_number, frame, frame)
            self.next_number += 1
            self.live.append(chosen)
        chosen.add(frame, x, y, conf, track, move and not frozen(chosen))
        return chosen


@dataclass(frozen=True)
class EntityRules:
    gap_frames: int = 300
    radius_m: float = 25.0
    fps: float = 30.0
    max_speed_mps: float = 8.0


@dataclass
class Sighting:
    """Last known place of an entity."""

    number: int
    last_frame: int
    cluster: object = None
    lat: float | None = None
    lon: float | None = None
    drone_lat: float | None = None
    drone_lon: float | None = None


class EntityBook:
    """Stable identities of one video stretch."""

    def __init__(self, rules: EntityRules, next_number: int = 1):
        self.rules = rules
        self.entities: dict[int, Sighting] = {}
        self.by_track: dict[object, tuple[int, int]] = {}
        self.next_number = next_number
        self.frame: int | None = None
        self.used: set[int] = set()
        self.inherited, self.tied = 1, False

    @classmethod
    def restored(cls, rules: EntityRules, state: str | None) -> EntityBook:
        """An empty book, or one that ``save`` gave."""
        book = cls(rules)
        if state is not None:
            told = json.loads(state)
            book.next_number = told["next"]
            book.entities = {e[0]: Sighting(*e) for e in told["entities"]}
            book.by_track = {t: (n, f) for t, n, f in told["tracks"]}
        return book

    def save(self, frame: int) -> str:
        gap = self.rules.gap_frames
        kept = [e for e in self.entities.values() if frame - e.last_frame <= gap]
        tracks = [(t, n, f) for t, (n, f) in self.by_track.items() if frame - f <= gap]
        fields = [(e.number, e.last_frame, e.cluster, e.lat, e.lon, e.drone_lat, e.drone_lon) for e in kept]
        return json.dumps({"next": self.next_number, "entities": fields, "tracks": tracks})

    def live(self, frame: int) -> list[tuple[int, list]]:
        gap = self.rules.gap_frames
        tracks: dict[int, list] = {}
        for t, (n, f) in self.by_track.items():
            if frame - f <= gap:
                tracks.setdefault(n, []).append((t, f))
        return [
            (e.number, [e.last_frame, e.cluster, e.lat, e.lon, e.drone_lat, e.drone_lon, sorted(tracks.get(e.number, []))])
            for e in self.entities.values() if frame - e.last_frame <= gap
        ]

    def step(self, *row) -> tuple[int]:
        return (self.resolve(*row),)

    def _turn(self, frame: int) -> None:
        if frame == self.frame:
            return
        self.frame, self.used = frame, set()
        gap = self.rules.gap_frames
        self.entities = {k: e for k, e in self.entities.items() if frame - e.last_frame <= gap}
        self.by_track = {t: v for t, v in self.by_track.items() if frame - v[1] <= gap}

    def _match(self, e: Sighting, frame: int, lat, lon, dlat, dlon) -> float | None:
        """Distance when the entity may have come here, else None."""
        r = self.rules
        if not _known(e.lat):
            return None
        reach = r.radius_m
        if r.fps > 0 and r.max_speed_mps > 0:
            travelled = max(1, frame - e.last_frame) / r.fps * r.max_speed_mps + LEAST_REACH_M
            reach = min(reach, max(LEAST_REACH_M, travelled))
        distance = metres_between(lat, lon, e.lat, e.lon)
        if _known(dlat) and _known(dlon) and _known(e.drone_lat):
            flown = metres_between(dlat, dlon, e.drone_lat, e.drone_lon)
            reach = min(r.radius_m, reach + DRONE_SHARE * flown)
            ex, ny = offset_metres(lat, lon, dlat, dlon)
            px, py = offset_metres(e.lat, e.lon, e.drone_lat, e.drone_lon)
            distance = min(distance, DRONE_STRETCH * math.hypot(ex - px, ny - py))
        return distance if distance <= reach else None

    def resolve(self, frame: int, track, cluster, lat, lon, dlat, dlon) -> int:
        """Identity of a detection: its track's, the closest reachable one not used in
        this frame (the same cluster counts as closer), or a new one."""
        self._turn(frame)
        number = None
        if track is not None and track in self.by_track:
            number = self.by_track[track][0]
        if number is None and _known(lat) and _known(lon):
            best = math.inf
            for e in self.entities.values():
                if e.number in self.used:
                    continue
                d = self._match(e, frame, lat, lon, dlat, dlon)
                if d is None:
                    continue
                if cluster is not None and e.cluster == cluster:
                    d *= SAME_CLUSTER_SHARE
                if d < best:
                    best, number = d, e.number
                elif d == best and max(e.number, number) < self.inherited:
                    self.tied = True
        if number is None:
            number = self.next_number
            self.next_number += 1
        e = self.entities.setdefault(number, Sighting(number, frame))
        e.last_frame, e.cluster = frame, cluster
        if _known(lat) and _known(lon):
            e.lat, e.lon = lat, lon
        if _known(dlat) and _known(dlon):
            e.drone_lat, e.drone_lon = dlat, dlon
        if track is not None:
            self.by_track[track] = (number, frame)
        self.used.add(number)
        return number


class ClassVote:
    """Running class scores of one key; the shown class changes only on a clear lead."""

    def __init__(self, margin: float, min_hits: int = 1):
        self.margin, self.min_hits = max(0.0, margin), min_hits
        self.score: dict[int, float] = {}
        self.hits: dict[int, int] = {}
        self.stable: int | None = None

    def add(self, cls: int, conf: float) -> int:
        self.score[cls] = self.score.get(cls, 0.0) + max(conf, 0.0)
        self.hits[cls] = self.hits.get(cls, 0) + 1
        lead = max(self.score, key=self.score.get)
        if self.stable is None:
            self.stable = lead
        elif (
            lead != self.stable
            and self.hits[lead] >= self.min_hits
            and self.score[lead] >= self.score.get(self.stable, 0.0) + self.margin
        ):
            self.stable = lead
        return self.stable


class MotionBook:
    """Counter by planar motion: the nearest entity not seen at this time, if it can have moved here."""

    def __init__(self, speed: float = 12.0, limit: float = 30.0, a: float = 70.0):
        self.speed, self.limit, self.a = speed, limit, a
        self.last: list[tuple[float, float, float]] = []  # north, east, time per entity
        # Entities by the cell of their last place; nobody comes from beyond the next cell.
        self.cells: dict[tuple[int, int], set[int]] = {}

    def _cell(self, north: float, east: float) -> tuple[int, int]:
        width = max(self.limit, 1e-9)
        return math.floor(north / width), math.floor(east / width)

    def reach(self, seconds: float) -> float:
        n = math.ceil(seconds)
        total = 0.0
        for k in range(max(n, 0)):
            total += self.a / (self.a + k)
            if self.speed * total >= self.limit:
                return self.limit
        return self.speed * total

    def place(self, north: float, east: float, t: float) -> tuple[int, bool]:
        """0-based entity and whether it is new."""
        best = None
        a, b = here = self._cell(north, east)
        last, cells = self.last, self.cells
        for x in (a - 1, a, a + 1):
            for y in (b - 1, b, b + 1):
                for i in cells.get((x, y), ()):
                    n, e, seen = last[i]
                    if seen == t:
                        continue
                    d = math.hypot(n - north, e - east)
                    # The one that was there first, if several are as near.
                    if best is None or d < best[0] or d == best[0] and i < best[1]:
                        best = (d, i, seen, (x, y))
        if best is not None and self.reach(t - best[2]) > best[0]:
            i, new, old = best[1], False, best[3]
            last[i] = (north, east, t)
            if old != here:
                cells[old].discard(i)
                if not cells[old]:
                    del cells[old]
                cells.setdefault(here, set()).add(i)
        else:
            i, new = len(last), True
            last.append((north, east, t))
            cells.setdefault(here, set()).add(i)
        return i, new
