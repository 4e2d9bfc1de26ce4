"""Importance resampling toward a target corpus, by hashed n-gram features.

Each batch interns its n-grams in an open-addressed table of numpy arrays: XXH64 keys name the first
slot, equal keys are verified byte for byte, and others step to the next slot. A slot stores its
n-gram's bucket and count, so CRC-32 runs once for each distinct n-gram, and the slot numbers of all
occurrences gather the gains. Two passes read the texts: the first sums buckets, the second scores
documents. What the driver holds are the sums of ``buckets`` buckets and histograms of scores in
steps of 256, whatever the number of documents.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from canopy.llm.common import LOWER, id_text, joined_words, text_groups, written

#: Words are ASCII letters and digits and everything beyond ASCII; other bytes part them.
WORDS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in LOWER)
AT_ONCE = 1 << 18


@dataclass(frozen=True)
class Resampling:
    """``n``: longest run of words; ``percent`` of the documents with ``least_words`` words are drawn."""

    n: int = 1
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 10
    seed: str = "2024"


def _equal(data: bytes, view: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether ``size`` bytes at ``a`` and at ``b`` agree; ``view`` has eight bytes from each place on."""
    same = np.ones(len(a), dtype=bool)
    for at in range(0, 64, 8):
        open_ = np.flatnonzero(same & (size > at))
        if not len(open_):
            return same
        x, y = (np.ascontiguousarray(view[p[open_] + at]).view("<u8").ravel() for p in (a, b))
        cut = (np.uint64(8) * (8 - np.minimum(size[open_] - at, 8)).astype(np.uint64)).astype(np.uint64)
        same[open_] = (x << cut) == (y << cut)
    for i in np.flatnonzero(same & (size > 64)):
        same[i] = data[a[i] : a[i] + size[i]] == data[b[i] : b[i] + size[i]]
    return same


def intern(
    data: bytes, starts: np.ndarray, ends: np.ndarray, digest: Callable[[bytes], int] = xxhash.xxh64_intdigest
) -> tuple[np.ndarray, np.ndarray]:
    """The slot of every occurrence ``data[start:end]``, and the occurrence that owns each slot (-1: free).

    Equal n-grams share a slot and different ones never do, whatever ``digest`` gives.
    """
    n = len(starts)
    keys = np.fromiter((digest(data[a:b]) for a, b in zip(starts.tolist(), ends.tolist())), dtype=np.uint64, count=n)
    size = ends - starts
    last = (1 << max(4, (2 * n).bit_length())) - 1
    owner = np.full(last + 1, -1, dtype=np.int64)
    slot = (keys & np.uint64(last)).astype(np.int64)
    view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data + bytes(72), dtype=np.uint8), 8)
    pending = np.arange(n)
    while len(pending):
        at = slot[pending]
        free = owner[at] < 0
        owner[at[free]] = pending[free]
        other = owner[at]
        found = (keys[other] == keys[pending]) & (size[other] == size[pending])
        twice = np.flatnonzero(found & (other != pending))
        found[twice] = _equal(data, view, starts[other[twice]], starts[pending[twice]], size[pending[twice]])
        pending = pending[~found]
        slot[pending] = (slot[pending] + 1) & last
    return slot, owner


def _occurrences(texts: list[bytes], n: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of 1 to ``n`` words: the bytes they lie in, their starts and ends, and their texts."""
    data, starts, ends, text = joined_words(texts, WORDS)
    for k in range(n):
        for at in range(0, max(len(starts) - k, 0), AT_ONCE):
            to = min(at + AT_ONCE, len(starts) - k)
            whole = text[at:to] == text[at + k : to + k]
            a, b = starts[at:to][whole], ends[at + k : to + k][whole]
            if len(a):
                low = int(a[0])
                yield data[low : int(b[-1])], a - low, b - low, text[at:to][whole]


def _bucketed(data: bytes, starts: np.ndarray, ends: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slot of each occurrence, and each slot's bucket and count."""
    slot, owner = intern(data, starts, ends)
    bucket = np.zeros(len(owner), dtype=np.int64)
    used = np.flatnonzero(owner >= 0)
    a, b = starts[owner[used]].tolist(), ends[owner[used]].tolist()
    bucket[used] = [zlib.crc32(data[i:j]) % buckets for i, j in zip(a, b)]
    return slot, bucket, np.bincount(slot, minlength=len(owner))


def bucket_counts(df: DataFrame, p: Resampling = Resampling(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``bucket int, n long``: features of all rows by bucket; each task sends a row for each bucket it met."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(p.buckets, dtype=np.int64)
        for _, texts in text_groups(batches):
            for data, starts, ends, _ in _occurrences(texts, p.n):
                _, bucket, n = _bucketed(data, starts, ends, p.buckets)
                np.add.at(total, bucket, n)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], ["bucket", "n"])

    return id_text(df, id_col, text_col).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """``floor(1000 ln((t+1)(S+B) / ((s+1)(T+B))))`` of every bucket, in doubles."""
    s_all, t_all = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)
    ratio = lambda b: (target.get(b, 0) + 1.0) * s_all / ((source.get(b, 0) + 1.0) * t_all)
    return np.array([math.floor(1000 * math.log(ratio(b))) for b in range(buckets)], dtype=np.int64)


def noise(doc_id: int | None, seed: str) -> int:
    """``floor(1000 x)`` of the document's standard Gumbel value x, drawn from a hash of seed and id."""
    h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(df: DataFrame, gain: np.ndarray, p: Resampling = Resampling(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` (long), one row for each row of ``df``."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_groups(batches):
            n, total = np.zeros((2, len(ids)), dtype=np.int64)
            for data, starts, ends, text in _occurrences(texts, p.n):
                slot, bucket, _ = _bucketed(data, starts, ends, p.buckets)
                first = np.flatnonzero(np.diff(text, prepend=-1))
                n[text[first]] += np.diff(first, append=len(text))
                total[text[first]] += np.add.reduceat(gain[bucket[slot]], first)
            words = np.bincount(joined_words(texts, WORDS)[3], minlength=len(ids))
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            drawn = weight + np.array([noise(i, p.seed) for i in ids], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *map(pa.array, (words.astype(np.int64), n, weight, drawn))],
                ["doc_id", "n_words", "n_features", "weight", "score"],
            )

    schema = "doc_id long, n_words long, n_features long, weight long, score long"
    return id_text(df, id_col, text_col).mapInArrow(score, schema)


def _least_score(able: DataFrame, draw: int) -> int | None:
    """The score of the ``draw``-th best row, from histograms: of steps of 256, then of scores in one step."""
    if not draw:
        return None
    step = F.floor(F.col("score") / 256)
    left = draw
    for found in (step, F.col("score")):
        counts = able.groupBy(found.alias("at")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("at")).collect()
        for at, n in counts:
            if left <= n:
                break
            left -= n
        able = able.where(step == at)
    return at


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``rank`` from 1, best score first, ties to the smaller id (null last).

    Rows are dealt out by ranges of the order and sorted inside each; a partition's ranks begin
    after the rows of those before it. ``seq``, a number of each row, parts equal rows.
    """
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("seq")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = written(placed, "importance-drawn").withColumn("piece", F.shiftright("at", 33))
    sizes = placed.groupBy("piece").agg(F.count(F.lit(1)).alias("size"))
    # One row for each partition.
    before = sizes.select("piece", F.coalesce(F.sum("size").over(W.orderBy("piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(before, "piece").select(*rows.columns, rank.alias("rank"))


def resample(
    df: DataFrame, target: DataFrame, p: Resampling = Resampling(), id_col: str = "doc_id", text_col: str = "text",
    target_text: str = "text",
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` (long) for every row of ``df``.

    A document's weight is the floored mean of its features' gains toward ``target`` (none: 0), its
    score adds Gumbel noise of its id, and the ``percent`` best scores of the documents with
    ``least_words`` words are drawn without replacement; ``rank`` is their order, null for the rest.

    Null and empty texts have no features; a null id draws noise as the empty id does and loses
    ties. Repeated rows are rows of their own, each with its rank. An empty table gives an empty
    one, and an empty target leaves every document to the gains of missing buckets. Texts of any
    length are taken whole. Other columns are left out, so their names cannot clash.
    """
    target = target.select(F.lit(None).cast("long").alias("doc_id"), F.col(f"`{target_text}`").alias("text"))
    tables = (bucket_counts(df, p, id_col, text_col), bucket_counts(target, p))
    # At most one row for each bucket.
    source, wanted = ({r.bucket: r.n for r in t.collect()} for t in tables)
    scored = weigh(df, gains(source, wanted, p.buckets), p, id_col, text_col)
    scored = written(scored.withColumn("seq", F.monotonically_increasing_id()), "importance-scored")
    able = F.col("n_words") >= p.least_words
    draw = p.percent * scored.where(able).count() // 100
    least = _least_score(scored.where(able), draw)
    columns = ["doc_id", "n_features", "weight", "score"]
    if least is None:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    near = able & (F.col("score") >= least)
    rank = F.when(F.col("rank") <= draw, F.col("rank")).alias("rank")
    rest = scored.where(~near).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked(scored.where(near)).select(*columns, rank).unionByName(rest)
