"""SimHash near-duplicates: popcounts of segments as grid coordinates, joined by range, verified exactly.

A fingerprint's 64 bits are cut into 16 segments of four; its embedding is the vector of their
bit counts. Flipping a bit moves one count by one, so the Manhattan distance of two embeddings
never exceeds the Hamming distance of the fingerprints, and fingerprints within two bits lie
within distance two on the grid. Two grid points within distance two share a point within
distance one of both. So each fingerprint is filed under its own point and the up to 32 points
beside it, and partners meet in some cell, where the Hamming distance is checked.

A cell with over ``CELL`` fingerprints is not paired. Its fingerprints are filed again with 64
segments of one bit, where a cell's members differ by two bits at most: they need no check and
no pairs, only a link to the smallest. So the work stays in proportion to the fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from canopy.llm.common import LOWER, id_text, raw, sliced, written
from canopy.llm.components import components

CELL = 64
SHINGLES_AT_ONCE = 1 << 16
SEGMENTS = 16


def fingerprint(text: bytes) -> bytes:
    """Eight bytes, most significant first: bits set in over half the hashes of 3-word shingles."""
    words = text.translate(LOWER).split()
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    ends = ends[2:] or ends[-1:]
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, dtype=np.int64), len(ends)
    for at in range(0, n, SHINGLES_AT_ONCE):
        cut = slice(at, at + SHINGLES_AT_ONCE)
        hashes = [digest(joined[i:j], 42) for i, j in zip(starts[cut], ends[cut])]
        bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n).tobytes()


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp``: the fingerprint's 64 bits as a signed long, one row for each row."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            prints = b"".join(map(fingerprint, raw(batch.column(1))))
            signed = np.frombuffer(prints, dtype=">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed)], ["doc_id", "fp"])

    return id_text(df, id_col, text_col).mapInArrow(hashed, "doc_id long, fp long")


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as the links (a, b), with one link from each vertex to its smallest."""
    vertices, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(vertices))
    while True:
        low = np.minimum(label[x], label[y])
        now = label.copy()
        np.minimum.at(now, x, low)
        np.minimum.at(now, y, low)
        np.minimum.at(now, label[x], low)
        np.minimum.at(now, label[y], low)
        now = now[now]
        if (now == label).all():
            break
        label = now
    own = label != np.arange(len(vertices))
    return vertices[own], vertices[label[own]]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, fp), sorted: links (a, b) found in small cells; fingerprints of crowded cells as (a, null)."""

    def crowd(fps: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(fps), pa.nulls(len(fps), pa.int64())], ["a", "b"])

    def links(cells: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = []
        for k in range(1, CELL):
            same = np.flatnonzero(cells[k:] == cells[:-k]) if k < len(cells) else ()
            if not len(same):
                break
            near = same[np.bitwise_count(fps[same].view(np.uint64) ^ fps[same + k].view(np.uint64)) <= 2]
            found.append((fps[near], fps[near + k]))
        if found and sum(len(a) for a, _ in found):
            a, b = _stars(np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found]))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    cells = fps = np.empty(0, dtype=np.int64)
    crowded = None  # the cell whose rows have already been passed on as crowded
    for batch in batches:
        cells = np.concatenate([cells, batch.column(0).to_numpy(zero_copy_only=False)])
        fps = np.concatenate([fps, batch.column(1).to_numpy(zero_copy_only=False)])
        if crowded is not None and len(cells):
            own = int(np.searchsorted(cells != crowded, True))
            if own:
                yield crowd(fps[:own])
            cells, fps = cells[own:], fps[own:]
            crowded = None if len(cells) else crowded
        if not len(cells):
            continue
        edges = np.concatenate([[0], np.flatnonzero(np.diff(cells)) + 1, [len(cells)]])
        size = np.repeat(np.diff(edges), np.diff(edges))
        over = size > CELL
        last = int(edges[-2])
        closed = np.arange(len(cells)) < last
        if (over & closed).any():
            yield crowd(fps[over & closed])
        yield from links(cells[closed & ~over], fps[closed & ~over])
        if over[last]:
            yield crowd(fps[last:])
            crowded, cells, fps = int(cells[last]), cells[:0], fps[:0]
        else:
            cells, fps = cells[last:], fps[last:]
    yield from links(cells, fps)


def _cells(nodes: DataFrame) -> DataFrame:
    """``cell, fp``: the grid point of each fingerprint and the points beside it, four bits a count."""
    # One bit of each segment at a time; a count is four at most, so no sum reaches the sign bit.
    ones = F.lit(int("1" * SEGMENTS, 16))
    counts = sum((F.shiftrightunsigned("fp", i).bitwiseAND(ones) for i in range(1, 4)), F.col("fp").bitwiseAND(ones))
    own = F.col("point")
    beside = []
    for i in range(SEGMENTS):
        count, step = F.shiftrightunsigned(own, 4 * i).bitwiseAND(F.lit(15)), F.lit(1 << 4 * i)
        beside += [F.when(count < 4, own + step), F.when(count > 0, own - step)]
    filed = F.explode(F.array_compact(F.array(own, *beside)))
    return nodes.select("fp", counts.alias("point")).select(filed.alias("cell"), "fp")


def links(nodes: DataFrame) -> DataFrame:
    """``a, b``: links whose components are those of all pairs of ``nodes.fp`` at two bits or fewer."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    filed = _cells(nodes).repartition(parts, "cell").sortWithinPartitions("cell", "fp")
    met = written(filed.mapInArrow(_meet, "a long, b long"), "simhash-met")
    crowded = met.where("b is null").select(F.col("a").alias("fp")).distinct()
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << i) if i < 63 else -(1 << 63))) for i in range(64)])
    fine = crowded.select(F.explode(flips).alias("cell"), "fp")
    # At most 65 fingerprints are within one bit of a cell, so these groups are small by themselves.
    met_fine = fine.groupBy("cell").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    stars = met_fine.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).where("a != b")
    return met.where("b is not null").unionByName(stars)


def groups(prints: DataFrame) -> DataFrame:
    """``fp, component_id, keep_id, keep_fp`` for every distinct ``prints.fp``.

    ``component_id`` is the smallest id of the component (null ids only: null). ``keep_*`` names
    the one row that stays: the smallest id and, for an id that occurs twice, the smaller print.
    """
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-nodes")
    roots = components(links(nodes), "simhash-links")
    linked = roots.select(F.col("u").alias("fp"), "root").unionByName(
        roots.select(F.col("root").alias("fp"), "root").distinct()
    )
    linked = linked.join(nodes, "fp")
    least = linked.groupBy("root").agg(F.min(F.struct(F.col("first_id").isNull().alias("no"), "first_id", "fp")).alias("keep"))
    found = linked.join(least, "root").select("fp", "keep")
    return nodes.join(found, "fp", "left").select(
        "fp",
        F.when(F.col("keep").isNull(), F.col("first_id")).otherwise(F.col("keep.first_id")).alias("component_id"),
        F.when(F.col("keep").isNull(), F.col("first_id")).otherwise(F.col("keep.first_id")).alias("keep_id"),
        F.coalesce("keep.fp", "fp").alias("keep_fp"),
    )


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id``: one row for each row of ``df``.

    ``fingerprint`` has 16 lowercase hex digits; ``component_id`` is the smallest id reachable over
    links of two or fewer differing bits, its own included. A null or empty text has fingerprint
    zero and is linked like any other. A null id stays null and never names a component that has
    another id. Repeated rows and equal texts share a fingerprint and so a component. An empty
    table gives an empty one; other columns are left out.
    """
    prints = written(fingerprints(df, id_col, text_col), "simhash-prints")
    found = groups(prints).select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(found, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay: one of each component, that with the smallest id.

    Rows are written once with their fingerprint. Columns come back as they are, whatever their
    names. A null text counts as empty; of a component with null ids only, one row stays; of
    rows alike in id and fingerprint, one; an empty table gives an empty one.
    """
    index = df.columns.index(text_col)
    one = StructType([StructField("row", df.schema), StructField("doc_id", LongType()), StructField("fp", LongType())])
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            prints = b"".join(map(fingerprint, raw(batch.column(0).field(index).cast(pa.string()))))
            signed = pa.array(np.frombuffer(prints, dtype=">i8").astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, signed], ["row", "doc_id", "fp"])

    rows = written(packed.mapInArrow(hashed, one), "simhash-rows")
    kept = groups(rows.select("doc_id", "fp")).where("fp = keep_fp").select("keep_id", "keep_fp")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("fp") == F.col("keep_fp"))
    return rows.join(kept, stays, "left_semi").dropDuplicates(["doc_id", "fp"]).select("row.*")
