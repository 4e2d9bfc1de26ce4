"""Byte-level BPE over overlapping chunks.

A text is cut into chunks that overlap, so that one long text spreads over tasks. Each chunk is
split into pre-tokens by itself. The split has no memory: a pre-token begins where the last one
ended and looks only ahead. So as soon as the boundaries of a chunk and of the one before it
agree at one place, they agree from there on, and the text is stitched at that place. Boundaries
within ``MARGIN`` of a chunk's end are not trusted, as what follows could still move them. Where
two chunks agree nowhere in their overlap (a run longer than the overlap), they become one piece
and the pre-tokens are found over both. The pieces are then encoded each for itself, and their
ids in order are the ids of the text. Decoding joins the bytes of the ids.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from canopy.llm.common import id_text, sliced, written

CHUNK = 32768
OVERLAP = 1024
MARGIN = 4  # a contraction's two letters, and the character after a run
CACHE = 400_000
LONG_PIECE = 64
NO_RANK = 1 << 40


@lru_cache(maxsize=4)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Ranks, the split pattern, and ids of the pieces met so far (bounded)."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks = _ranks(path)
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.told = {i: str(i) for i in self.bytes_of}
        self.pattern = regex.compile(pattern)
        self.known: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Merge the neighbours of lowest rank, the leftmost first, until no pair has a rank."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        if len(piece) > LONG_PIECE:
            return self._merge_long(piece)
        get = self.ranks.get
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [get(a + b, NO_RANK) for a, b in zip(parts, parts[1:])]
        while pairs and (best := min(pairs)) != NO_RANK:
            at = pairs.index(best)
            parts[at] += parts.pop(at + 1)
            del pairs[at]
            if at:
                pairs[at - 1] = get(parts[at - 1] + parts[at], NO_RANK)
            if at < len(pairs):
                pairs[at] = get(parts[at] + parts[at + 1], NO_RANK)
        return tuple(map(self.ranks.__getitem__, parts))

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same merges from a heap, so that a run of any length takes n log n steps."""
        ranks, n = self.ranks, len(piece)
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue  # one of the two has been merged since
            alive[j], end[i], after[i] = False, stop, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if (k := before[i]) >= 0 and (r := ranks.get(piece[k:stop])) is not None:
                heapq.heappush(heap, (r, k, stop))
        return tuple(ranks[piece[i : end[i]]] for i in range(n) if alive[i])

    def encode(self, text: str) -> list[int]:
        known, pieces = self.known, self.pattern.findall(text)
        new = set(pieces).difference(known)
        if len(known) + len(new) > CACHE:
            known.clear()
            new = set(pieces)
        long = {p: self.merge(p.encode()) for p in new if len(p) > LONG_PIECE}  # not kept
        for p in new:
            if p not in long:
                known[p] = self.merge(p.encode())
        if long:
            return list(chain.from_iterable(long.get(p) or known[p] for p in pieces))
        return list(chain.from_iterable(map(known.__getitem__, pieces)))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def tell(self, ids) -> str:
        return " ".join(map(self.told.__getitem__, ids))

    def boundaries(self, text: str) -> np.ndarray:
        return np.fromiter((m.start() for m in self.pattern.finditer(text)), dtype=np.int64)


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One for each Python process; every task that follows there finds its pieces."""
    return Codec(path, pattern)


def _slices(rows: Iterator[tuple], schema: pa.Schema, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Batches of (row, number, ..., text), closed when their texts reach ``most`` characters."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _pieces(long: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """``row, piece, text`` of the long texts: stretches that may be encoded apart, in order of ``piece``.

    Between chunks only places travel: a chunk tells those boundaries that lie in its overlaps.
    """
    step = chunk - overlap
    dealt = int(long.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = [pa.field("row", pa.int64()), pa.field("k", pa.int32())]
    chunked = pa.schema([*kinds, pa.field("last", pa.int32()), pa.field("text", pa.string())])
    cut = pa.schema([*kinds, pa.field("text", pa.string())])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    last = max(-(-(len(text) - overlap) // step), 1) - 1
                    for k in range(last + 1):
                        yield row, k, last, text[k * step : k * step + chunk]

        yield from _slices(rows(), chunked)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in sliced(batches, 64):
            heads, tails = [], []
            for k, last, text in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                found = c.boundaries(text)
                limit = len(text) if k == last else len(text) - MARGIN
                heads.append((found[(found < min(overlap, limit))] + k * step).tolist() if k else [])
                tails.append((found[(found >= step) & (found < limit)] + k * step).tolist() if k < last else [])
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(heads, kind), pa.array(tails, kind)], ["row", "k", "head", "tail"]
            )

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for row, text, cuts in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    edges = [0, *sorted(set(cuts or ())), len(text)]
                    for k, (a, b) in enumerate(zip(edges, edges[1:])):
                        yield row, k, text[a:b]

        yield from _slices(rows(), cut)

    parts = long.select("row", "text").mapInArrow(chunks, "row long, k int, last int, text string").repartition(dealt, "row", "k")
    found = written(parts.mapInArrow(places, "row long, k int, head array<long>, tail array<long>"), "bpe-places")
    before = found.select("row", (F.col("k") + 1).alias("k"), F.col("tail").alias("before"))
    # The first place on which a chunk and the one before agree; none leaves both in one piece.
    joints = found.where("k > 0").join(before, ["row", "k"]).select(
        "row", F.array_min(F.array_intersect("head", "before")).alias("at")
    )
    cuts = joints.where("at is not null").groupBy("row").agg(F.collect_list("at").alias("cuts"))
    whole = long.join(cuts, "row", "left").select("row", "text", "cuts")
    return whole.mapInArrow(stretches, "row long, k int, text string").repartition(dealt, "row", "k")


def _ids_of(texts: DataFrame, path: str, pattern: str) -> DataFrame:
    """The columns of ``texts`` with ``text``, the last one, replaced by its ``ids``."""
    names = texts.columns[:-1]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in sliced(batches):
            ids = pa.array([c.encode(x) for x in batch.column(len(names)).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], [*names, "ids"])

    kinds = "".join(f"{n} {texts.schema[n].dataType.simpleString()}, " for n in names)
    return texts.mapInArrow(told, f"{kinds}ids array<int>")


def _parted(df: DataFrame, id_col: str, text_col: str, chunk: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """Texts within one chunk, and longer ones with a row number of their own (ids may be null or repeat)."""
    if not MARGIN < overlap < chunk:
        raise ValueError("the overlap must be longer than the margin and shorter than a chunk")
    docs = id_text(df, id_col, text_col)
    long = docs.where(F.length("text") > chunk).withColumn("row", F.monotonically_increasing_id())
    return docs.where(F.length("text") <= chunk), written(long, "bpe-long")


def _long_ids(long: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    coded = _ids_of(_pieces(long, path, pattern, chunk, overlap), path, pattern)
    # One group is one text, which has been one row before.
    joined = coded.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("parts"))
    ids = joined.select("row", F.flatten(F.transform("parts", lambda x: x.ids)).alias("ids"))
    return long.select("doc_id", "row").join(ids, "row").select("doc_id", "ids")


def encode(
    df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
    chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """``doc_id, ids array<int>``, one row for each row of ``df``; ``path`` names a file of ranks.

    A null or empty text has no ids; a null id stays null; repeated rows and equal texts give a
    row each; an empty table gives an empty one; other columns are left out. Special tokens are
    ordinary text. A text within one chunk is encoded where it is read, without a shuffle.
    """
    short, long = _parted(df, id_col, text_col, chunk, overlap)
    return _ids_of(short, path, pattern).unionByName(_long_ids(long, path, pattern, chunk, overlap))


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, bytes``: the bytes of the ids, joined; a null list gives no bytes, an unknown id fails."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, "")
        for batch in sliced(batches):
            found = [c.decode(x or ()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["doc_id", "bytes"])

    ids = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{ids_col}`").alias("ids"))
    return ids.mapInArrow(joined, "doc_id long, bytes binary")


def _digest(c: Codec, ids: list[int]) -> tuple[int, str, str]:
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return len(ids), sha(c.tell(ids).encode()), sha(c.decode(ids))


def round_trip(
    df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
    chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: texts encoded, and their ids decoded again.

    As ``encode`` and ``decode`` one after the other, but ids do not leave the task that has them.
    """
    short, long = _parted(df, id_col, text_col, chunk, overlap)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def digests(of) -> object:
        def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = codec(path, pattern)
            for batch in sliced(batches):
                rows = [_digest(c, of(c, x)) for x in batch.column(1).to_pylist()]
                n, ids, text = zip(*rows) if rows else ((), (), ())
                arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return told

    there = short.mapInArrow(digests(lambda c, text: c.encode(text)), schema)
    return there.unionByName(_long_ids(long, path, pattern, chunk, overlap).mapInArrow(digests(lambda c, ids: ids), schema))
