"""Identity rules against straightforward re-statements on small random scenes."""

import math
import random

import pytest
from pyspark.sql import functions as F

from canopy.operators import fragments as Fr, paths as P, tracking as Tr
from canopy.operators.matching import ClassVote, MotionBook, metres_between

LAT0, LON0 = 54.0, 24.0
PER_LAT = 111320.0
COLS = "det_id long, video_id string, frame int, x1 double, y1 double, x2 double, y2 double, conf double, cls int, name string, track_id int, lat double, lon double, lat_drone double, lon_drone double"


def _scene(seed, n=400, spread=60.0, frames=900):
    """Animals walking at random; tracks change hands, some positions are missing."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        frame = rng.randrange(frames)
        if rng.random() < 0.5:
            frame = frame // 3  # crowded start, sparse end
        animal = rng.randrange(6)
        north = animal * spread / 6 + rng.gauss(0, 2.0)
        east = (animal % 2) * spread + rng.gauss(0, 2.0)
        lat = LAT0 + north / PER_LAT
        lon = LON0 + east / (PER_LAT * math.cos(math.radians(LAT0)))
        track = None if rng.random() < 0.2 else rng.choice([animal, animal + 10 * (frame // 200)])
        pos = (None, None) if rng.random() < 0.05 else (lat, lon)
        box = [rng.random() * 500, rng.random() * 300]
        rows.append((i, "v", frame, box[0], box[1], box[0] + 30, box[1] + 30, round(rng.random(), 3), rng.randrange(3), f"c{rng.randrange(2)}",
                     track, *pos, LAT0 + frame * 1e-7, LON0))
    return rows


def _ordered(rows):
    return sorted(rows, key=lambda r: (r[2], -r[7], r[3], r[4], r[0]))


def _clusters(rows, r, idle, freeze, reassoc):
    """One pass over the whole video, nothing cut apart, nothing evicted."""
    clusters, out, origin = [], {}, None
    for d in _ordered(rows):
        frame, conf, track, lat, lon = d[2], d[7], d[10], d[11], d[12]
        if lat is None:
            out[d[0]] = None
            continue
        origin = origin or (lat, lon)
        x = (lon - origin[1]) * PER_LAT * math.cos(math.radians(origin[0]))
        y = (lat - origin[0]) * PER_LAT
        live = [c for c in clusters if frame - c["last"] <= idle]
        for c in live:
            c["d"] = math.hypot(x - c["x"], y - c["y"])
        pick, move = None, True
        if track is not None:
            own = [c for c in live if track in c["tracks"] and c["d"] <= max(2 * r, 12)]
            pick = min(own, key=lambda c: c["d"]) if own else None
        if pick is None:
            near = [c for c in live if c["d"] <= r and not (track is not None and c["tracks"] and track not in c["tracks"] and c["d"] > r * 0.45)]
            pick = min(near, key=lambda c: c["d"]) if near else None
        if pick is None:
            back = [c for c in live if freeze is not None and c["n"] >= freeze and c["d"] <= min(reassoc, max(3 * r, 25))
                    and not (track is not None and c["tracks"] and track not in c["tracks"])]
            if back:
                pick, move = min(back, key=lambda c: c["d"]), False
        if pick is None:
            pick = {"id": len(clusters) + 1, "n": 0, "w": 0.0, "sx": 0.0, "sy": 0.0, "tracks": set()}
            clusters.append(pick)
        if pick["n"] == 0 or (move and (freeze is None or pick["n"] < freeze)):
            w = max(conf, 1e-3)
            pick["w"] += w
            pick["sx"] += x * w
            pick["sy"] += y * w
            pick["x"], pick["y"] = pick["sx"] / pick["w"], pick["sy"] / pick["w"]
        pick["n"] += 1
        pick["last"] = frame
        if track is not None:
            pick["tracks"].add(track)
        out[d[0]] = (pick["id"], pick["n"])
    return out


@pytest.mark.parametrize("seed,params", [(1, (5.0, 120, 30, 30.0)), (2, (2.0, 15, 4, 30.0)), (3, (1.0, 40, None, 8.0)), (4, (3.0, 5, 2, 6.0))])
def test_spatial_clusters(spark, seed, params):
    rows = _scene(seed)
    r, idle, freeze, reassoc = params
    want = _clusters(rows, r, idle, freeze, reassoc)
    got = Tr.spatial_clusters(spark.createDataFrame(rows, COLS), r, idle, 3, freeze, reassoc).collect()
    assert {g.det_id: None if g.cluster_id is None else (g.cluster_id, g.cluster_hits) for g in got} == want


def _entities(rows, gap, radius, fps, speed, cluster=None):
    states, owner, seen, out, nxt = {}, {}, {}, {}, 1
    frame_now, used = None, set()
    for d in _ordered(rows):
        frame, track, lat, lon, dlat, dlon = d[2], d[10], d[11], d[12], d[13], d[14]
        if frame != frame_now:
            frame_now, used = frame, set()
        eid = None
        if track is not None and track in owner and frame - seen.get(track, -10**7) <= gap:
            eid = owner[track]
        if eid is None:
            best = None
            for cid, s in states.items():
                if cid in used or frame - s["f"] > gap or lat is None or s.get("lat") is None:
                    continue
                reach = min(radius, max(6.0, max(1, frame - s["f"]) / fps * speed + 6.0))
                reach = min(radius, reach + 0.9 * metres_between(dlat, dlon, s["dlat"], s["dlon"]))
                rel = lambda a, b, p, q: ((b - q) * PER_LAT * math.cos(math.radians((a + p) / 2)), (a - p) * PER_LAT)
                e1, n1 = rel(lat, lon, dlat, dlon)
                e2, n2 = rel(s["lat"], s["lon"], s["dlat"], s["dlon"])
                m = min(metres_between(lat, lon, s["lat"], s["lon"]), 1.15 * math.hypot(e1 - e2, n1 - n2))
                if m <= reach and (best is None or m < best[0]):
                    best = (m, cid)
            if best:
                eid = best[1]
            else:
                eid, nxt = nxt, nxt + 1
        s = states.setdefault(eid, {})
        s["f"] = frame
        if lat is not None:
            s["lat"], s["lon"] = lat, lon
        s["dlat"], s["dlon"] = dlat, dlon
        if track is not None:
            owner[track], seen[track] = eid, frame
        used.add(eid)
        out[d[0]] = eid
    return out


@pytest.mark.parametrize("seed,params", [(5, (300, 25.0, 30.0, 8.0)), (6, (12, 10.0, 5.0, 2.0)), (7, (3, 4.0, 1.0, 1.0))])
def test_resolve_entities(spark, seed, params):
    rows = _scene(seed)
    got = Tr.resolve_entities(spark.createDataFrame(rows, COLS), *params).collect()
    assert {g.det_id: g.entity_id for g in got} == _entities(rows, *params)


def test_class_vote():
    """A lead by the margin is needed, and repeated hits where asked for."""
    v = ClassVote(1.5)
    assert [v.add(c, p) for c, p in [(1, 0.9), (2, 0.9), (2, 0.9), (2, 0.9)]] == [1, 1, 1, 2]
    v = ClassVote(0.1, min_hits=3)
    assert [v.add(c, p) for c, p in [(1, 0.2), (2, 0.9), (2, 0.9), (2, 0.1)]] == [1, 1, 1, 2]


def test_smooth_class(spark):
    rows = _scene(8)
    got = {g.det_id: g.cls for g in Tr.smooth_class(spark.createDataFrame(rows, COLS), "track_id", 0.5).collect()}
    votes = {}
    for d in _ordered(rows):
        want = d[8] if d[10] is None else votes.setdefault(d[10], ClassVote(0.5)).add(d[8], d[7])
        assert got[d[0]] == want


def _iou(a, b):
    w = min(a[2], b[2]) - max(a[0], b[0])
    h = min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    return w * h / (area(a) + area(b) - w * h)


def test_suppress_overlaps(spark):
    rng = random.Random(9)
    rows = []
    for i in range(300):
        x, y = rng.randrange(0, 400, 3), rng.randrange(0, 60, 3)
        s = rng.choice([30, 34, 40])
        rows.append((i, "v", 0 if i % 3 else i % 7, float(x), float(y), float(x + s), float(y + s), round(rng.random(), 2), rng.randrange(2), "a", None, None, None, None, None))
    kept = []
    for d in _ordered(rows):
        box = d[3:7]
        mid = ((box[0] + box[2]) / 2, (box[1] + box[3]) / 2)
        bad = False
        for k in kept:
            if k[2] != d[2]:
                continue
            o = _iou(box, k[3:7])
            far = math.hypot(mid[0] - (k[3] + k[5]) / 2, mid[1] - (k[4] + k[6]) / 2)
            bad |= o >= 0.65 or (k[8] == d[8] and far <= 28 and o >= 0.35)
        if not bad:
            kept.append(d)
    got = Tr.suppress_overlaps(spark.createDataFrame(rows, COLS)).collect()
    assert {g.det_id for g in got} == {k[0] for k in kept} and len(kept) < 300


# --- fragments ---------------------------------------------------------------

EDGES = "video_id string, src long, dst long, end_frame long, start_frame long, distance_m double, allowed_m double, score double"


def _edges(rng, n):
    frag = [(i, t := rng.randrange(500), t + rng.randrange(1, 20)) for i in range(n)]
    out = []
    for s in frag:
        for d in frag:
            if 0 < d[1] - s[2] <= 25:
                out.append(("v", s[0], d[0], s[2], d[1], 1.0, 2.0, round(rng.random(), 2)))
    return out


def test_greedy_links(spark):
    edges = _edges(random.Random(11), 60)
    followed, preceded, want = set(), set(), set()
    for e in sorted(edges, key=lambda e: (e[7], e[5], e[1], e[2])):
        if e[1] not in followed and e[2] not in preceded:
            followed.add(e[1])
            preceded.add(e[2])
            want.add((e[1], e[2]))
    links = Fr.greedy_links(spark.createDataFrame(edges, EDGES))
    assert {(r.src, r.dst) for r in links.collect()} == want
    heads = {r.entity_id: r.merged_id for r in Fr.chain_heads(links).collect()}
    up = {b: a for a, b in want}
    for f in up:
        top = f
        while top in up:
            top = up[top]
        assert heads[f] == top
    assert set(heads) == set(up)


@pytest.mark.parametrize("first", ["early", "late"])
def test_chain_of_three(spark, first):
    """A, B, C chain merges in either order of scores; the compat rule only when B-C comes first."""
    ab, bc = (0.1, 0.2) if first == "early" else (0.2, 0.1)
    edges = spark.createDataFrame([("v", 1, 2, 10, 12, 1.0, 9.0, ab), ("v", 2, 3, 20, 22, 1.0, 9.0, bc)], EDGES)
    det = spark.createDataFrame([("v", i, i) for i in (1, 2, 3)], "video_id string, entity_id long, track_id long")
    merged = lambda compat: sorted(r.entity_id for r in Fr.merge_fragments(det, edges, compat).collect())
    assert merged(False) == [1, 1, 1]
    assert merged(True) == ([1, 1, 1] if first == "late" else [1, 1, 3])


# --- counting, paths ---------------------------------------------------------

def test_motion_book():
    b = MotionBook(speed=2.0, limit=30.0)
    assert b.place(0, 0, 0) == (0, True)
    assert b.place(1.5, 0, 0) == (1, True)  # seen at the same time
    assert b.place(1.0, 0, 1) == (1, False)
    assert b.place(0.9, 0, 1) == (0, False)
    assert b.place(100, 0, 2) == (2, True)
    assert MotionBook(12).reach(2) == pytest.approx(12 * (1 + 70 / 71)) and MotionBook(12).reach(50) == 30


def test_motion_book_by_cells():
    """The nearest by cells is the nearest of all, ties and negative places included."""
    rng = random.Random(12)
    book, last = MotionBook(4.0, 6.0), []
    for t in range(300):
        for _ in range(rng.randrange(4)):
            north, east = rng.randrange(-20, 20), rng.randrange(-20, 20)
            free = [(math.hypot(n - north, e - east), i, s) for i, (n, e, s) in enumerate(last) if s != t]
            best = min(free, key=lambda p: p[0], default=None)
            if best and book.reach(t - best[2]) > best[0]:
                want = (best[1], False)
                last[best[1]] = (north, east, t)
            else:
                want = (len(last), True)
                last.append((north, east, t))
            assert book.place(north, east, t) == want


def test_count_unique_by_motion_cuts_nothing_apart(spark):
    """Places far apart are counted in parallel; the count equals one book over everything."""
    rng = random.Random(13)
    det, tel, i = [], [], 0
    for frame in range(80):
        lat = LAT0 + (frame // 2) * 2e-5  # every second frame repeats the position
        tel.append(("v", frame, float(frame), lat, LON0, 60.0, float(frame % 5)))
        for _ in range(rng.randrange(3)):
            x, y = rng.randrange(0, 600), rng.randrange(0, 480)
            det.append((i, "v", frame, float(x), float(y), x + 30.0, y + 30.0, round(rng.random(), 2), 0, "a", None))
            i += 1
    d = spark.createDataFrame(det, ", ".join(COLS.split(", ")[:11]))
    t = spark.createDataFrame(tel, "video_id string, frame int, ts double, lat double, lon double, rel_alt double, gb_yaw double")
    got = Tr.count_unique_by_motion(d, t, 640, 512, speed=3.0).orderBy("frame", F.col("conf").desc(), "x1", "y1", "det_id").collect()
    book, ids = MotionBook(3.0), []
    for r in got:
        ids.append(book.place(r.north, r.east, r.ts)[0] + 1)
    assert [r.entity_id for r in got] == ids
    assert {r.frame for r in got} <= set(range(0, 80, 2))


def _rdp(pts, eps):
    if len(pts) < 3:
        return pts
    (x1, y1), (x2, y2) = pts[0][1:], pts[-1][1:]
    far = lambda p: math.hypot(p[1] - x1, p[2] - y1) if (x1, y1) == (x2, y2) else abs((y2 - y1) * p[1] - (x2 - x1) * p[2] + x2 * y1 - y2 * x1) / math.hypot(y2 - y1, x2 - x1)
    best = max(range(1, len(pts) - 1), key=lambda i: (far(pts[i]), -i))
    if far(pts[best]) > eps:
        return _rdp(pts[: best + 1], eps)[:-1] + _rdp(pts[best:], eps)
    return [pts[0], pts[-1]]


def test_greedy_links_long_path(spark):
    """2,600 edges in a path, each beaten by the one before: every second one is taken."""
    edges = [("v", i, i + 1, i, i + 1, 1.0, 2.0, 0.1 + i * 1e-4) for i in range(2600)]
    links = Fr.greedy_links(spark.createDataFrame(edges, EDGES))
    # An edge competes for its source or its target only, and the next one for neither: all stay.
    assert links.count() == 2600
    heads = Fr.chain_heads(links)
    assert {r.merged_id for r in heads.collect()} == {0} and heads.count() == 2600


def test_greedy_links_competing(spark):
    """Sources and targets shared in turns: greedy order takes every second edge."""
    edges = []
    for i in range(1300):  # s_i -> t_i, then t_i is also wanted by s_(i+1)
        edges += [("v", 2 * i, 2 * i + 1, 1, 2, 1.0, 2.0, 2 * i * 1e-4), ("v", 2 * i + 2, 2 * i + 1, 1, 2, 1.0, 2.0, (2 * i + 1) * 1e-4)]
    links = Fr.greedy_links(spark.createDataFrame(edges, EDGES))
    assert sorted((r.src, r.dst) for r in links.collect()) == [(2 * i, 2 * i + 1) for i in range(1300)]


@pytest.mark.parametrize("limit", [50_000, 20])
def test_simplify_path(spark, limit):
    rng = random.Random(17)
    rows, want = [], set()
    for track in range(3):
        lat, lon, pts = 0.0, 0.0, []
        for seq in range(1, 90):
            lat, lon = lat + rng.gauss(0, 1), lon + rng.gauss(0.5, 1)
            pts.append((seq, lat, lon))
            rows.append(("v", track, seq, lat, lon))
        want |= {(track, p[0]) for p in _rdp(pts, 2.0)}
    df = spark.createDataFrame(rows, "video_id string, track_id int, seq long, lat double, lon double")
    got = P.simplify_path(df, 2.0, limit=limit).collect()
    assert {(r.track_id, r.seq) for r in got} == want


def test_clusters_with_limits_per_video(spark):
    """Freeze and reach given per video equal two runs with fixed values."""
    rows = _scene(31) + [(r[0] + 1000, "w", *r[2:]) for r in _scene(32)]
    det = spark.createDataFrame(rows, COLS)
    given = det.withColumn("fz", F.when(F.col("video_id") == "v", 3)).withColumn("ra", F.when(F.col("video_id") == "v", 9.0).otherwise(30.0))
    got = {r.det_id: (r.cluster_id, r.cluster_hits) for r in Tr.spatial_clusters(given, 2.0, 15, 3, "fz", "ra").collect()}
    for video, freeze, reach in (("v", 3, 9.0), ("w", None, 30.0)):
        want = _clusters([r for r in rows if r[1] == video], 2.0, 15, freeze, reach)
        assert all(got[k] == (v or (None, None)) for k, v in want.items())


def test_wildlife(spark):
    """Two animals, one lost and found again: counted twice, not three times."""
    from canopy.plans.wildlife import WildlifeParams, wildlife

    det, tel, i = [], [], 0
    for frame in range(60):
        tel.append(("v", frame, frame / 10, LAT0, LON0, 60.0, 60.0, 160.0, 40.0, 1.0, 0.0, -90.0, 0.0, "t"))
        for animal, x in ((0, 100.0), (1, 500.0)):
            if animal == 1 and 20 <= frame < 30:
                continue
            track = animal if animal == 0 or frame < 20 else 7
            det.append((i, "v", frame, x, 200.0, x + 40, 240.0, 0.9, 1 if frame % 10 == 5 else 0, "deer", track))
            i += 1
        if frame == 40:
            det.append((i, "v", frame, 102.0, 201.0, 142.0, 241.0, 0.5, 0, "deer", 9))
            i += 1
    d = spark.createDataFrame(det, ", ".join(COLS.split(", ")[:11]))
    t = spark.createDataFrame(
        tel, "video_id string, frame int, ts double, lat double, lon double, alt double, rel_alt double, abs_alt double, "
             "focal_len double, dzoom_ratio double, gb_yaw double, gb_pitch double, gb_roll double, utc string")
    out = wildlife(d, t, WildlifeParams(fps=10.0), ["deer", "boar"])
    assert out["entities"].first().animals == 2
    rows = out["detections"].collect()
    # The doubled box is gone, flickering classes are held, everything stands.
    assert len(rows) == 110 and {r.name for r in rows} == {"deer"} and {r.status for r in rows} == {"confirmed"}
    assert {r.frames for r in out["tracks"].collect()} == {60, 50}
    assert sum(r.frames for r in out["clusters"].collect()) == 110


def test_few_boxes_without_arrays(monkeypatch):
    """Frames of a few boxes make no arrays; with nulls or very many boxes all results are the same."""
    import random

    r = random.Random(31)
    for n, odd in ((5, 0.0), (300, 0.0), (60, 0.1)):
        boxes = []
        for _ in range(n):
            x, y = r.uniform(0, 40 * n**0.5), r.uniform(0, 40 * n**0.5)
            box = [x, y, x + r.uniform(0, 60), y + r.uniform(0, 60), r.randint(0, 2)]
            boxes.append([None if r.random() < odd else v for v in box])
        few = Tr._box_step(0.5, 28.0)
        got = [few(*b)[0] for b in boxes]
        with monkeypatch.context() as m:
            m.setattr(Tr, "FEW", 1)
            arrays = Tr._box_step(0.5, 28.0)
            assert got == [arrays(*b)[0] for b in boxes]
    with monkeypatch.context() as m:
        for name in ("array", "empty", "clip"):
            m.setattr(Tr.np, name, None)
        step = Tr._box_step(0.5, 28.0)
        assert [step(*b)[0] for b in ([0, 0, 10, 10, 1], [1, 0, 11, 10, 1], [30, 0, 40, 10, 1])] == [True, False, True]
