"""Removal of repeated byte strings by run-length compressed indexes over anchored contexts.

Which 200-byte strings occur twice is settled in three steps.

1. *Anchors.* Every window of ``length`` bytes names the ``GRAM``-byte string in it whose hash is
   least, the leftmost of equals. Equal windows name equal strings at the same offset, so they
   meet under one anchor wherever they are. Consecutive windows that name the same anchor form a
   record; its *context* is all bytes those windows cover (at most ``2 * length - GRAM``).
2. *Records.* An anchor seen once has no repeats. A context that occurs twice, whole, repeats in
   all its windows, which settles the inside of long copies without their bytes. What is left are
   anchors with several different contexts: the edges of copies.
3. *Indexes.* The different contexts of such anchors are sorted by anchor and indexed in blocks of
   whole anchors: suffix order by doubling, the Burrows-Wheeler transform cut into runs, and the
   suffixes sampled at run heads and run ends. Inside a run the longest match of a suffix is one
   shorter than that of the suffix one byte before, so only the samples are compared with their
   neighbours, and matching statistics of all positions stream from them in text order. Windows
   whose match reaches ``length`` repeat.

An anchor with over ``BLOCK`` bytes of different contexts (a passage at which very many different
texts begin) is not indexed in one task: its windows are counted by a 128-bit hash, over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from canopy.llm.common import id_text, raw, sliced, written

LENGTH = 200
GRAM = 32
BLOCK = 4 << 20
STRETCH = 1 << 19  # window starts taken at once; positions in a stretch need 20 bits
SPAN_BITS = 20  # a record's first window and its number of windows share a long
_PLACE = np.uint64((1 << 20) - 1)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``GRAM`` bytes from each position, put together from its halves."""
    x = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,)) * _M1
    x ^= x >> np.uint64(29)
    size = 8
    while size < GRAM:
        x = x[:-size] * _M2 + x[size:]
        x ^= x >> np.uint64(32)
        x *= _M1
        size *= 2
    return x


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def records(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, context, first window, windows) of the records of a text, in its order."""
    parts = []
    windows = len(text) - length + 1
    for at in range(0, windows, STRETCH):
        piece = text[at : at + min(STRETCH, windows - at) + length - 1]
        grams = _grams(np.frombuffer(piece, dtype=np.uint8))
        keyed = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        place = (_least(keyed, length - GRAM + 1) & _PLACE).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        last = np.concatenate([first[1:], [len(place)]])
        digest = xxhash.xxh3_64_intdigest
        context = np.fromiter(
            (digest(piece[a : b + length - 1]) for a, b in zip(first.tolist(), last.tolist())), dtype=np.uint64, count=len(first)
        )
        parts.append((grams[place[first]].view(np.int64), context.view(np.int64), first + at, last - first))
    if not parts:
        return (np.empty(0, dtype=np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*parts))


def _docs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows by id and text: rows alike in both have the same repeats, so they need no number."""
    return id_text(df, id_col, text_col).withColumn("print", F.xxhash64("text"))


def _merged(owner: np.ndarray, anchor: np.ndarray, context: np.ndarray, span: np.ndarray) -> tuple:
    """Equal contexts of one text as one record: its first span, and the others as a list.

    A text of one repeated line has as many records as bytes, all alike; so they leave it as one.
    """
    more: list[list[int] | None] = [None] * len(owner)
    mixed = context.view(np.uint64) ^ (owner.astype(np.uint64) * _M1)
    if len(np.unique(mixed)) == len(mixed):
        return owner, anchor, context, span, more
    order = np.lexsort((span, context, anchor, owner))
    owner, anchor, context, span = owner[order], anchor[order], context[order], span[order]
    same = (owner[1:] == owner[:-1]) & (anchor[1:] == anchor[:-1]) & (context[1:] == context[:-1])
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    last = np.append(first[1:], len(owner))
    more = [span[a + 1 : b].tolist() if b > a + 1 else None for a, b in zip(first.tolist(), last.tolist())]
    return owner[first], anchor[first], context[first], span[first], more


def _recorded(docs: DataFrame, length: int) -> DataFrame:
    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [records(x, length) for x in raw(batch.column(2))]
            owner = np.repeat(np.arange(len(found)), [len(x[0]) for x in found])
            if not len(owner):
                continue
            anchor, context, first, n = (np.concatenate(x) for x in zip(*found))
            owner, anchor, context, span, more = _merged(owner, anchor, context, first << SPAN_BITS | n)
            rows = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(anchor), pa.array(context),
                 pa.array(span), pa.array(more, pa.list_(pa.int64()))],
                ["doc_id", "print", "anchor", "context", "span", "more"],
            )

    schema = "doc_id long, print long, anchor long, context long, span long, more array<long>"
    return docs.select("doc_id", "print", "text").mapInArrow(told, schema)


def _classified(found: DataFrame) -> DataFrame:
    """Records of anchors seen twice or more; ``whole``: the context occurs again; ``fetch``: its bytes are needed.

    Of equal contexts one is fetched, as what others may share a part with.
    """
    by, ordered = W.partitionBy("anchor"), W.partitionBy("anchor").orderBy("context")
    seen = found.select(
        "*",
        F.coalesce(F.lag("context").over(ordered) == F.col("context"), F.lit(False)).alias("again"),
        F.coalesce(F.lead("context").over(ordered) == F.col("context"), F.lit(False)).alias("before"),
    )
    seen = seen.withColumn("several", F.min("context").over(by) != F.max("context").over(by))
    whole = F.col("again") | F.col("before") | F.col("more").isNotNull()
    return seen.where(whole | F.col("several")).select(
        "doc_id", "print", "anchor", "span", "more", whole.alias("whole"), F.expr("several and not again").alias("fetch")
    )


# --- the index of a block ------------------------------------------------------------------------


def suffix_ranks(text: np.ndarray) -> np.ndarray:
    """The rank of every suffix; suffixes must differ (a shorter one that ends is less)."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, dtype=np.uint8)])
    key = np.ndarray((n,), dtype=">u8", buffer=padded, strides=(1,)).astype(np.uint64)
    order = np.argsort(key)
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    starts = np.flatnonzero(new)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = starts[np.cumsum(new) - 1]
    sizes = np.diff(np.append(starts, n))
    tied = order[np.repeat(sizes > 1, sizes)]
    step = 8
    while len(tied):
        after = tied + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        key = rank[tied] * (n + 1) + second + 1
        by = np.argsort(key)
        tied, key = tied[by], key[by]
        group = rank[tied]
        new_group = np.concatenate([[True], group[1:] != group[:-1]])
        new_key = np.concatenate([[True], key[1:] != key[:-1]])
        place = np.arange(len(tied))
        in_group = place - np.maximum.accumulate(np.where(new_group, place, 0))
        rank[tied] = group + np.maximum.accumulate(np.where(new_key, place, 0)) - (place - in_group)
        starts = np.flatnonzero(new_key)
        sizes = np.diff(np.append(starts, len(tied)))
        tied = tied[np.repeat(sizes > 1, sizes)]
        step *= 2
    return rank


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of the suffixes a and b, eight bytes at a time."""
    padded = np.concatenate([text, np.zeros(16, dtype=np.uint8)])
    words = np.ndarray((len(text) + 8,), dtype="<u8", buffer=padded, strides=(1,))
    out = np.zeros(len(a), dtype=np.int64)
    live = np.arange(len(a))
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        inside = np.maximum(x, y) < len(text)
        live, x, y = live[inside], x[inside], y[inside]
        differ = words[x] ^ words[y]
        same = differ == 0
        low = differ & (~differ + np.uint64(1))  # the lowest bit that differs
        out[live[~same]] += (np.bitwise_count(low[~same] - np.uint64(1)) >> 3).astype(np.int64)
        out[live[same]] += 8
        live = live[same]
    return np.minimum(out, len(text) - np.maximum(a, b))


class RunIndex:
    """Run-compressed transform of a text with the suffixes and match lengths at run heads and ends."""

    def __init__(self, text: np.ndarray) -> None:
        self.n = len(text)
        rank = suffix_ranks(text)
        suffix = np.empty(self.n, dtype=np.int64)
        suffix[rank] = np.arange(self.n)
        bwt = text[suffix - 1]
        # No byte is before the suffix at 0, which is a run of its own: where the last byte stands
        # for it, it may lie inside a run, and neither it nor its neighbours would be sampled.
        cut = bwt[1:] != bwt[:-1]
        cut[max(rank[0] - 1, 0) : rank[0] + 1] = True
        edges = np.flatnonzero(cut) + 1
        heads = np.concatenate([[0], edges])
        ends = np.concatenate([edges, [self.n]]) - 1
        self.runs = bwt[heads], ends - heads + 1
        self.heads, self.ends = suffix[heads], suffix[ends]
        between = np.append(_common(text, suffix[edges - 1], suffix[edges]), 0)
        self.head_match = np.append(0, between[:-1])  # with the suffix before the head
        self.end_match = between  # with the suffix after the end

    def _streamed(self, sampled: np.ndarray, match: np.ndarray) -> np.ndarray:
        """From each sample on, the match is one shorter at each next position, up to the next sample."""
        at = np.full(self.n, -1, dtype=np.int64)
        at[sampled] = sampled
        length = np.zeros(self.n, dtype=np.int64)
        length[sampled] = match
        at = np.maximum.accumulate(at)
        out = length[np.maximum(at, 0)] - (np.arange(self.n) - at)
        return np.where(at < 0, 0, np.maximum(out, 0))

    def matches(self) -> np.ndarray:
        """Matching statistics of the text against itself: the longest match elsewhere, by position."""
        return np.maximum(self._streamed(self.heads, self.head_match), self._streamed(self.ends, self.end_match))


def repeated_starts(contexts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For each context, (first, number) of the runs of windows that occur anywhere else among the contexts.

    Each context ends with its number in five bytes that UTF-8 never has, which part equal ends.
    Windows that reach into such an end are left out; the others match inside contexts only, also
    those that begin within a character.
    """
    ends = [bytes(0xF5 + i // 11**k % 11 for k in (4, 3, 2, 1, 0)) for i in range(len(contexts))]
    text = np.frombuffer(b"".join(x for pair in zip(contexts, ends) for x in pair), dtype=np.uint8)
    sizes = np.fromiter(map(len, contexts), dtype=np.int64, count=len(contexts))
    begins = np.concatenate([[0], np.cumsum(sizes + 5)])[:-1]
    # Only windows inside a context count; ends match too, and would join the runs beside them.
    edges, long = np.zeros(len(text) + 1, dtype=np.int8), sizes >= length
    edges[begins[long]], edges[(begins + sizes - length + 1)[long]] = 1, -1
    marked = (RunIndex(text).matches() >= length) & (np.cumsum(edges[:-1]) > 0)
    change = np.diff(np.concatenate([[0], marked.astype(np.int8), [0]]))
    first, last = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    out: list[list[tuple[int, int]]] = [[] for _ in contexts]
    owner = np.searchsorted(begins, first, side="right") - 1
    for i, a, b in zip(owner.tolist(), first.tolist(), last.tolist()):
        out[i].append((a - int(begins[i]), b - a))
    return out


# --- Spark ---------------------------------------------------------------------------------------

_MARK = pa.schema(
    [("doc_id", pa.int64()), ("print", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("bytes", pa.binary())]
)
_MARK_SQL = "doc_id long, print long, start long, n long, bytes binary"


def _contexts(docs: DataFrame, classes: DataFrame, length: int) -> DataFrame:
    """``anchor, whole, doc_id, print, start, bytes``: the contexts that have to be fetched."""
    wanted = classes.where("fetch").groupBy("doc_id", "print").agg(F.collect_list(F.struct("anchor", "span", "whole")).alias("wanted"))
    on = F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.print") == F.col("w.print"))
    joined = docs.alias("d").join(wanted.alias("w"), on).select("d.doc_id", "d.print", "text", "wanted")
    names = ["anchor", "whole", "doc_id", "print", "start", "bytes"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for doc, mark, text, wanted_ in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw(batch.column(2)), batch.column(3).to_pylist()
            ):
                for x in wanted_:
                    first, n = x["span"] >> SPAN_BITS, x["span"] & ((1 << SPAN_BITS) - 1)
                    rows.append((x["anchor"], x["whole"], doc, mark, first, text[first : first + n + length - 1]))
            if rows:
                kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return joined.mapInArrow(cut, "anchor long, whole boolean, doc_id long, print long, start long, bytes binary")


def _indexed(contexts: DataFrame, length: int, block: int) -> DataFrame:
    """Marks (start, n) of repeated windows; contexts of crowded anchors come as they are, with ``bytes``."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _MARK)], schema=_MARK)

    def marks(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        found = repeated_starts([x[5] for x in held], length)
        rows = [(x[2], x[3], x[4] + a, n, None) for x, runs in zip(held, found) if not x[1] for a, n in runs]
        if rows:
            yield batch_of(rows)

    def crowd(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if rows:
            yield batch_of([(x[2], x[3], x[4], 0, x[5]) for x in rows])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        held, size = [], 0
        for _, group in groupby(rows, key=itemgetter(0)):
            own, own_size, crowded = [], 0, False
            for row in group:
                own.append(row)
                own_size += len(row[5]) + 5
                if own_size > block:
                    yield from crowd(own)
                    own, own_size, crowded = [], 0, True
            if crowded:
                yield from crowd(own)
                continue
            if held and size + own_size > block:
                yield from marks(held)
                held, size = [], 0
            held += own
            size += own_size
        if held:
            yield from marks(held)

    parts = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return contexts.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(index, _MARK_SQL)


def _counted(crowd: DataFrame, length: int) -> DataFrame:
    """Marks of crowded anchors: each window's 128-bit hash is counted over all tasks."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in sliced(batches, 2048):
            data = batch.column(3).to_pylist()
            counts = [len(x) - length + 1 for x in data]
            both = b"".join(digest(x[i : i + length]) for x, n in zip(data, counts) for i in range(n))
            halves = np.frombuffer(both, dtype="<i8").reshape(-1, 2)
            rows = pa.array(np.repeat(np.arange(len(data)), counts))
            first = np.repeat(batch.column(2).to_numpy(zero_copy_only=False), counts)
            inside = np.concatenate([np.arange(n) for n in counts]) if counts else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(first + inside),
                 pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())],
                ["doc_id", "print", "start", "h", "g"],
            )

    windows = crowd.select("doc_id", "print", "start", "bytes").mapInArrow(
        hashed, "doc_id long, print long, start long, h long, g long"
    )
    twice = windows.groupBy("h", "g").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("h", "g")
    return windows.join(twice, ["h", "g"]).select("doc_id", "print", "start", F.lit(1).cast("long").alias("n"))


def repeated_ranges(df: DataFrame, length: int = LENGTH, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, print, ranges``: runs (start, n) of window starts in bytes that occur anywhere else too."""
    if length < GRAM + 8 or 2 * length - GRAM + 5 > block:
        raise ValueError("a window must be longer than a gram, and a block than a context")
    docs = _docs(df, id_col, text_col)
    classes = written(_classified(_recorded(docs, length)), "repeat-records")
    found = written(_indexed(_contexts(docs, classes, length), length, block), "repeat-marks")
    edges = found.where("bytes is null").select("doc_id", "print", "start", "n")
    crowd = _counted(found.where("bytes is not null"), length)
    spans = F.explode(F.concat(F.array("span"), F.coalesce("more", F.array().cast("array<long>"))))
    inside = classes.where("whole").select("doc_id", "print", spans.alias("span")).select(
        "doc_id", "print", F.shiftright("span", SPAN_BITS).alias("start"), F.expr(f"span & {(1 << SPAN_BITS) - 1}").alias("n")
    )
    marks = inside.unionByName(edges).unionByName(crowd)
    # A group is one text's own ranges.
    return marks.groupBy("doc_id", "print").agg(F.collect_list(F.struct("start", "n")).alias("ranges"))


def _removed(ranges: list[dict] | None, size: int, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the ranges' windows cover."""
    out: list[list[int]] = []
    for a, b in sorted((x["start"], x["start"] + x["n"] + length - 1) for x in ranges or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, min(b, size)) for a, b in out]


def remove_repeats(
    df: DataFrame, length: int = LENGTH, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept, spans``: texts without their repeated bytes.

    Every byte goes that lies in a ``length``-byte string which also starts anywhere else, in the
    same text or another; strings are judged on the input. ``kept`` is binary, as cuts may part a
    character; ``spans`` are the (start, end) removed. One row for each row of ``df``: a null text
    is empty; texts below ``length`` bytes stay whole; rows alike in id and text repeat each
    other; null ids stay null; an empty table gives an empty one; other columns are left out.
    """
    docs = _docs(df, id_col, text_col)
    ranges = repeated_ranges(df, length, block, id_col, text_col)
    on = F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("d.print") == F.col("r.print"))
    joined = docs.alias("d").join(ranges.alias("r"), on, "left").select("d.doc_id", "text", "ranges")
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = raw(batch.column(1))
            spans = [_removed(x, len(t), length) for x, t in zip(batch.column(2).to_pylist(), texts)]
            kept = []
            for t, own in zip(texts, spans):
                edges = [0, *(x for ab in own for x in ab), len(t)]
                kept.append(b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2])))
            arrays = [
                batch.column(0),
                pa.array(map(len, texts), pa.int64()),
                pa.array([sum(b - a for a, b in x) for x in spans], pa.int64()),
                pa.array(map(len, spans), pa.int64()),
                pa.array(kept, pa.binary()),
                pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], pa.list_(span)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"])

    return joined.mapInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start: long, end: long>>"
    )


def repeat_report(df: DataFrame, length: int = LENGTH) -> DataFrame:
    """The counts of ``remove_repeats`` and the digest of what is kept."""
    return remove_repeats(df, length).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
