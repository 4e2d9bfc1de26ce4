"""Videos without pauses, folded in chunks, against one pass over all of it."""

import math
import random

import pytest
from pyspark.sql import functions as F

from canopy.operators import chunks, tracking as Tr
from canopy.operators.folds import independent_parts
from canopy.operators.matching import EntityBook, EntityRules
from tests.test_tracking import COLS, LAT0, LON0, PER_LAT, _clusters, _entities

GAP = 10


def _steady(seed, frames=2500, animals=3, grid=0.0, stay=400):
    """Something is seen at every few frames; animals come, walk and go; with ``grid``, positions repeat exactly."""
    r = random.Random(seed)
    rows, place, until, name = [], {}, {}, {}
    for frame in range(frames):
        for a in range(animals):
            if frame >= until.get(a, 0):
                place[a] = [r.uniform(-40, 40), r.uniform(-40, 40)]
                until[a], name[a] = frame + r.randint(stay // 4, stay), r.randrange(50)
            if r.random() < 0.45:
                continue
            place[a] = [p + r.gauss(0, 0.4) for p in place[a]]
            north, east = (round(p / grid) * grid if grid else p for p in place[a])
            lat, lon = LAT0 + north / PER_LAT, LON0 + east / (PER_LAT * math.cos(math.radians(LAT0)))
            if r.random() < 0.03:
                lat = lon = None
            track = None if r.random() < 0.5 else name[a]
            rows.append((len(rows), "v", frame, r.random() * 500, r.random() * 300, 1.0, 1.0, round(r.random(), 3), 0, "c", track, lat, lon,
                         LAT0 + frame * 1e-7, LON0))
    return rows


@pytest.fixture
def seen(monkeypatch):
    """What the fold decides about its chunks."""
    tables, cut = [], chunks.cut_lineage

    def keep(df):
        tables.append(cut(df))
        return tables[-1]

    monkeypatch.setattr(chunks, "cut_lineage", keep)
    monkeypatch.setattr(Tr, "CHUNK", 4)
    return tables


def _again(tables):
    """For each round of judging, how many chunks there are and how many must be folded again."""
    return [(len(r), sum(x["__again"] for x in r)) for t in tables if "__again" in t.columns for r in [t.collect()]]


@pytest.mark.parametrize("seed,grid", [(1, 0.0), (2, 0.0), (3, 4.0), (4, 8.0)])
def test_entities(spark, seen, seed, grid):
    rows = _steady(seed, grid=grid)
    rules = (GAP, 12.0, 10.0, 6.0)
    want = _entities(rows, *rules)
    got = Tr.resolve_entities(spark.createDataFrame(rows, COLS).repartition(5), *rules).collect()
    assert {g.det_id: g.entity_id for g in got} == want
    rounds = _again(seen)
    assert rounds[0][0] > 20  # about 80 frames a chunk
    if not grid:
        # Positions are forgotten after a pause, so nearly all chunks start with the book of the chunk before.
        assert rounds[0][1] <= 0.2 * rounds[0][0] and rounds[-1][1] == 0
    # Exact distances meet on a grid: order decides, and it is not taken for granted.


@pytest.mark.parametrize("seed,params", [(5, (3.0, GAP, 8, 20.0)), (6, (2.0, GAP, None, 8.0)), (7, (4.0, GAP, 3, 15.0))])
def test_clusters(spark, seen, seed, params):
    """Clusters remember all of their life: those that outlive a chunk are settled from the book before."""
    rows = _steady(seed, stay=60)
    radius, idle, freeze, reassoc = params
    want = _clusters(rows, radius, idle, freeze, reassoc)
    got = Tr.spatial_clusters(spark.createDataFrame(rows, COLS).repartition(5), radius, idle, 3, freeze, reassoc).collect()
    assert {g.det_id: None if g.cluster_id is None else (g.cluster_id, g.cluster_hits) for g in got} == want
    assert _again(seen)[0][0] > 5


def test_null_videos_and_lone_rows(spark, seen):
    """A null video is a video; rows that share no chunk edge with others need no record."""
    rows = _steady(8, frames=600)
    both = rows + [(r[0] + 100_000, None, *r[2:]) for r in rows] + [(999_999, "w", 5, *rows[0][3:])]
    want = _entities(rows, GAP, 12.0, 10.0, 6.0)
    got = {g.det_id: g.entity_id for g in Tr.resolve_entities(spark.createDataFrame(both, COLS), GAP, 12.0, 10.0, 6.0).collect()}
    assert got == want | {k + 100_000: v for k, v in want.items()} | {999_999: 1}


def test_empty(spark, seen):
    none = spark.createDataFrame([], COLS)
    assert Tr.resolve_entities(none).collect() == [] and Tr.spatial_clusters(none).collect() == []


def test_saved_books_go_on_alike():
    """A book that was saved at a frame goes on as the one that was not."""
    rows = sorted(_steady(9, frames=400), key=lambda r: (r[2], -r[7], r[3]))
    rules = EntityRules(GAP, 12.0, 10.0, 6.0)
    book, other = EntityBook(rules), None
    for r in rows:
        row = (r[2], r[10], None, r[11], r[12], r[13], r[14])
        if other is None and r[2] >= 200:
            other = EntityBook.restored(rules, book.save(r[2]))
            assert other.live(r[2]) == [(n, c) for n, c in book.live(r[2])]
        number = book.step(*row)
        assert other is None or other.step(*row) == number


def test_places_have_their_own_pauses(spark):
    """Rows at one place pause while another place is busy: the time of each place is cut again."""
    rows = [(0, f, 0.0) for f in range(100)] + [(0, f, 50.0) for f in (0, 1, 40, 41, 90)]
    df = spark.createDataFrame(rows, "video_id int, frame int, x double")
    axes = [("frame", "frame", 10.0, 10.0), ("x", "x", 5.0, 5.0)]
    parts = lambda a: independent_parts(df, ["video_id"], a).where(F.col("x") > 0).select("part").distinct().count()
    assert parts(axes) == 1 and parts([*axes, axes[0]]) == 3
