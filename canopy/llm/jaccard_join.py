"""Jaccard self-join of word n-gram sets by token-combination prefixes, as connected components.

Tokens (hashed n-grams) are put in one order, rare ones first. Those in few sets are a class of
single tokens; frequent ones are classes of which ``k``-token combinations are indexed, the more
frequent the longer. A frequent class is dealt into sub-classes by hash, so that combinations stay
few. A set's prefix is extended until its tokens, less ``k - 1`` for each sub-class met, exceed what
a linked set may lack: then two linked sets share a whole combination of some sub-class. Sub-classes
depend on a band of sizes; a set files combinations for every band a partner may have.

Sets that share a signature are candidates. Few of them are paired. In a crowded signature one set
is the hub (the one with the smallest share of rare tokens), and each set is first paired with the
hubs of three of its signatures; signatures whose sets still lie in several components are then
compared block by block on parity bitmaps, whose differing bits never exceed the sets' difference.
Candidates that pass are verified on whole sets. Sets of equal tokens are one vertex throughout.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from canopy.llm.common import LOWER_SPACED, id_text, joined_words, text_groups, written
from canopy.llm.components import components

#: Fixed values of the hash: an odd base, its inverse, and multipliers of the final mix.
BASE = 0x5851F42D4C957F2D
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15)
WINDOW = 1 << 18
BITS = 1024
KEY = ["k1", "k2"]
#: What a rare token sends: its signature's low bits, its set's ``k1``, and the set's size in steps.
RECORD = np.dtype([("sig", "<u4"), ("k1", "<i8"), ("step", "<u2")])
STEPS = 1024


@dataclass(frozen=True)
class Join:
    """Sets of ``words``-word shingles link at ``percent`` Jaccard similarity.

    ``levels``: tokens of at least so many sets are indexed in combinations of so many. Tasks hold
    the ``table`` most frequent tokens at most; where more are frequent, the first level rises.
    Signatures of more than ``crowd`` sets are crowded; ``bucket`` is the tokens that meet at once.
    """

    words: int = 5
    percent: int = 80
    levels: tuple[tuple[int, int], ...] = ((32, 2), (4096, 3))
    table: int = 1 << 20
    crowd: int = 8
    bucket: int = 1 << 20

    def least(self, n: int) -> int:
        """The fewest tokens that a set of ``n`` shares with a linked one."""
        return -(-self.percent * n // 100)

    def splits(self, band: int) -> int:
        """Sub-classes of each frequent class for sizes from ``2**band``; 0: single tokens there.

        About as many as the tokens that a linked set may lack. A prefix then meets one or two tokens
        of each, and the pairs of a set stay fewer than its tokens where all of them are frequent.
        Each may hold ``k - 1`` shared tokens without a shared combination, which bounds their number.
        """
        small = -(-self.percent * (1 << band) // 100)
        m = max(1, (1 << band) * (100 - self.percent) // 100)
        return min(m, (self.least(small) - 1) // sum(k - 1 for _, k in self.levels))

    def bands(self, n: int) -> range:
        low, high = -(-self.percent * n // 100), 100 * n // self.percent
        return range(low.bit_length() - 1, high.bit_length())


# --- tokens ------------------------------------------------------------------

def _powers(base: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.full(WINDOW - 1, base, dtype=np.uint64)]).cumprod(dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


class Hasher:
    """64-bit hashes of many pieces of one buffer, by prefix sums of a polynomial, all at once."""

    def __init__(self):
        self.up, self.down = _powers(BASE), _powers(pow(BASE, -1, 1 << 64))

    def __call__(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of ``data[start:end]``; starts and ends ascend. Pieces beyond the window have XXH64's."""
        out, i = np.empty(len(starts), dtype=np.uint64), 0
        while i < len(starts):
            low = int(starts[i])
            j = int(np.searchsorted(ends, low + WINDOW, side="right"))
            if j <= i:
                out[i] = xxhash.xxh64_intdigest(data[low : int(ends[i])], 7)
                i += 1
                continue
            byte = np.frombuffer(data, dtype=np.uint8, count=int(ends[j - 1]) - low, offset=low).astype(np.uint64)
            sums = np.zeros(len(byte) + 1, dtype=np.uint64)
            np.cumsum((byte + np.uint64(1)) * self.up[: len(byte)], out=sums[1:])
            a, b = starts[i:j] - low, ends[i:j] - low
            value = (sums[b] - sums[a]) * self.down[np.minimum(a, WINDOW - 1)]
            out[i:j] = mixed(value + (b - a).astype(np.uint64) * np.uint64(MIX[2]))
            i = j
        return out


def token_sets(texts: list[bytes], words: int, hasher: Hasher) -> list[np.ndarray]:
    """Each text's distinct tokens, ascending: hashes of its runs of ``words`` words, or of all if they are fewer."""
    data, starts, ends, text = joined_words(texts, LOWER_SPACED)
    edge = np.searchsorted(text, np.arange(len(texts) + 1))
    # The first words of runs; a shorter text's only run is all of it.
    size = np.diff(edge)
    runs = np.where(size >= words, size - words + 1, np.minimum(size, 1))
    first = np.repeat(edge[:-1], runs) + np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    last = np.minimum(first + words, np.repeat(edge[1:], runs)) - 1
    hashes = hasher(data, starts[first], ends[last])
    return [np.unique(part) for part in np.split(hashes, np.cumsum(runs)[:-1])]


def set_key(tokens: np.ndarray) -> tuple[int, int]:
    """96 bits that name a set, and its size: two signed longs."""
    digest = xxhash.xxh3_128_digest(tokens.astype("<u8").tobytes())
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(len(tokens).to_bytes(4, "little") + digest[8:12], "little", signed=True)


def _each(batches: Iterator[pa.RecordBatch], p: Join) -> Iterator[tuple[int | None, tuple[int, int], np.ndarray]]:
    """``doc_id, key, tokens`` of every row that has tokens; ``None, None`` and no tokens for the others."""
    hasher = Hasher()
    for ids, texts in text_groups(batches, WINDOW):
        for key, tokens in zip(ids, token_sets(texts, p.words, hasher)):
            yield key, set_key(tokens) if len(tokens) else (None, None), tokens


def _distinct(batches: Iterator[pa.RecordBatch], p: Join) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    """Each set of a task once, if sets other than itself can link to it."""
    seen = set()
    for _, key, tokens in _each(batches, p):
        n = len(tokens)
        if 100 * n >= p.percent * (n + 1) and key not in seen:
            seen.add(key)
            yield key, tokens


def _batch(columns: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def parity(tokens: np.ndarray) -> bytes:
    """Whether the tokens of each of ``m`` hash values are odd in number; ``m`` is a power of two, twice the set or more."""
    m = max(BITS, 1 << (2 * len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def documents_of(texts: DataFrame, p: Join) -> DataFrame:
    """``doc_id, k1, k2, n, bits``: the set of every row, its key, size and parities (null without tokens)."""
    schema = pa.schema([("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int64()), ("bits", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for doc_id, key, tokens in _each(batches, p):
            rows.append((doc_id, *key, len(tokens), parity(tokens) if len(tokens) else None))
            if len(rows) == 1024:
                yield _batch(dict(zip(schema.names, zip(*rows))), schema)
                rows = []
        if rows:
            yield _batch(dict(zip(schema.names, zip(*rows))), schema)

    return texts.mapInArrow(run, "doc_id long, k1 long, k2 long, n long, bits binary")


def one_each(texts: DataFrame, sets: DataFrame) -> DataFrame:
    """The texts of each set's smallest id; those of copies are left out.

    Else a token of a text with copies would count once for each task that has one, and look
    frequent, and each of them would send its signatures. An id with several texts brings all.
    """
    ids = sets.select(F.col("first_id").alias("id")).distinct()
    return written(texts.join(ids, texts.doc_id.eqNullSafe(ids.id), "left_semi"), "jaccard-texts")


# --- frequent tokens ---------------------------------------------------------

def _dealt(values: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Buckets by the top ``bits`` of ascending hashes, and where each lies."""
    top = (values >> np.uint64(64 - bits)).astype(np.int64)
    at = [0, *(np.flatnonzero(np.diff(top)) + 1).tolist(), len(top)]
    for a, b in zip(at, at[1:]):
        if b > a:
            yield int(top[a]), slice(a, b)


def _low(values: np.ndarray, bits: int) -> np.ndarray:
    """The 32 bits below the bucket's."""
    return ((values >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype("<u4")


def _by_bucket(
    df: DataFrame, columns: list[str], fn: Callable[[int, list[bytes]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``fn(bucket, joined blobs of each column)`` for every bucket; buckets are bounded by what is dealt into them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, [[] for _ in columns]
        for batch in batches:
            for b, *blobs in zip(*(batch.column(c).to_pylist() for c in ["bucket", *columns])):
                if b != bucket:
                    if bucket is not None:
                        yield from fn(bucket, [b"".join(h) for h in held])
                    bucket, held = b, [[] for _ in columns]
                for h, blob in zip(held, blobs):
                    h.append(blob)
        if bucket is not None:
            yield from fn(bucket, [b"".join(h) for h in held])

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def token_counts(texts: DataFrame, p: Join, bits: int) -> DataFrame:
    """``token, n``: tokens (their top ``32 + bits`` bits) of at least the first level's number of sets.

    Each task sends a token once for many sets; tokens travel as packed integers.
    """
    deal = pa.schema([("bucket", pa.int32()), ("once", pa.binary()), ("more", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[np.ndarray]) -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(held), return_counts=True)
            rows = []
            for bucket, part in _dealt(values, bits):
                low, count = _low(values[part], bits), n[part]
                twice = count > 1
                more = np.stack([low[twice], count[twice].astype("<u4")], axis=1)
                rows.append((bucket, low[~twice].tobytes(), more.tobytes()))
            return _batch(dict(zip(deal.names, zip(*rows))), deal)

        held, size = [], 0
        for _, tokens in _distinct(batches, p):
            held.append(tokens)
            size += len(tokens)
            if size >= 1 << 21:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    def count(bucket: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        once, more = np.frombuffer(blobs[0], "<u4"), np.frombuffer(blobs[1], "<u4").reshape(-1, 2)
        values, at = np.unique(np.concatenate([once, more[:, 0]]), return_inverse=True)
        n = np.bincount(at, np.concatenate([np.ones(len(once)), more[:, 1]])).astype(np.int64)
        often = np.flatnonzero(n >= p.levels[0][0])
        token = (bucket << 32) + values[often].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(n[often])], ["token", "n"])

    dealt = texts.mapInArrow(send, "bucket int, once binary, more binary")
    return _by_bucket(dealt, ["once", "more"], count, "token long, n long")


def frequent(counts: DataFrame, p: Join) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens, at most ``p.table``, ascending, and how many make a combination of each."""
    power = F.floor(F.log2("n")).cast("int")
    sizes = {r.at: r["count"] for r in counts.groupBy(power.alias("at")).count().collect()}  # a row for each power of two
    least, total = 0, 0
    for at in sorted(sizes, reverse=True):
        total += sizes[at]
        if total > p.table:
            least = 1 << at + 1
            break
    rows = counts.where(F.col("n") >= least).toArrow()
    order = np.argsort(rows["token"].to_numpy())
    token, n = rows["token"].to_numpy()[order].astype(np.uint64), rows["n"].to_numpy()[order]
    k = np.ones(len(n), dtype=np.int64)
    for level, size in p.levels:
        k[n >= level] = size
    return token, k


# --- signatures --------------------------------------------------------------

def _combined(tokens: np.ndarray, group: np.ndarray, k: int, seed: int) -> np.ndarray:
    """A hash of every ``k``-combination of tokens of one group; rows lie by group, then in token order."""
    at = np.arange(len(tokens))
    value = mixed(tokens + np.uint64(seed))
    for _ in range(k - 1):
        # Extend each combination by every later token of its group.
        end = np.searchsorted(group, group[at], side="right") if len(at) else at
        room = end - at - 1
        spread = np.repeat(np.arange(len(at)), room)
        step = np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room) + 1
        at = at[spread] + step
        value = mixed(value[spread] * np.uint64(MIX[2]) + tokens[at])
    return value


def signatures(tokens: np.ndarray, k: np.ndarray, p: Join) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of one set: single rare tokens, and combinations of frequent ones. ``k`` by token, 1 if rare."""
    need = len(tokens) - p.least(len(tokens)) + 1
    rare = tokens[k == 1]
    single = mixed(rare[:need])
    if len(rare) >= need:
        return single, single[:0]
    need -= len(rare)
    some, size = tokens[k > 1], k[k > 1]
    order = np.lexsort((some, size))
    some, size = some[order], size[order]
    found = []
    for band in p.bands(len(tokens)):
        m = p.splits(band)
        width = size if m else np.ones_like(size)
        group = size * (m + 1) + (mixed(some ^ np.uint64(MIX[0])) % np.uint64(max(m, 1))).astype(np.int64)
        by_group = np.lexsort((np.arange(len(some)), group))
        sorted_group = group[by_group]
        start = np.searchsorted(sorted_group, sorted_group)
        place = np.empty_like(start)
        place[by_group] = np.arange(len(some)) - start
        # A token counts once its group has k - 1 before it.
        counted = np.cumsum(place >= width - 1)
        prefix = by_group[by_group <= np.searchsorted(counted, need)]
        for one in np.unique(width[prefix]).tolist():
            part = prefix[width[prefix] == one]
            found.append(_combined(some[part], group[part], one, band * 8 + one))
    return single, np.concatenate(found)


def _signed(
    batches: Iterator[pa.RecordBatch], p: Join, bits: int, often: np.ndarray, size: np.ndarray
) -> Iterator[tuple[tuple[int, int], np.ndarray, np.ndarray, np.ndarray]]:
    """``key, k, single, many`` of each set: its tokens' classes and its signatures of either kind."""
    for key, tokens in _distinct(batches, p):
        short = tokens >> np.uint64(32 - bits)
        at = np.minimum(np.searchsorted(often, short), max(len(often) - 1, 0))
        k = np.where(often[at] == short, size[at], 1) if len(often) else np.ones(len(short), dtype=np.int64)
        yield key, k, *signatures(tokens, k, p)


def _step(n: int) -> int:
    return min(int(STEPS * np.log2(n)), 65535)


def _apart(p: Join) -> int:
    """How many steps the sizes of linked sets lie apart at most."""
    return int(STEPS * np.log2(100 / p.percent)) + 1


def single_rows(texts: DataFrame, p: Join, bits: int, held_once) -> DataFrame:
    """``bucket, pack``: what rare tokens send, packed; ``held_once`` has at most ``p.table`` tokens."""
    deal = pa.schema([("bucket", pa.int32()), ("pack", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            sig = np.concatenate([x for x, _, _ in held])
            rec = np.empty(len(sig), dtype=RECORD)
            n = [len(x) for x, _, _ in held]
            rec["k1"], rec["step"] = np.repeat([x for _, x, _ in held], n), np.repeat([x for _, _, x in held], n)
            order = np.argsort(sig, kind="stable")
            sig, rec = sig[order], rec[order]
            rec["sig"] = _low(sig, bits)
            rows = [(b, rec[part].tobytes()) for b, part in _dealt(sig, bits)]
            return _batch(dict(zip(deal.names, zip(*rows))), deal)

        held, total = [], 0
        for key, k, single, _ in _signed(batches, p, bits, *held_once.value):
            if len(single):
                held.append((single, key[0], _step(len(k))))
                total += len(single)
            if total >= 1 << 19:
                yield flush()
                held, total = [], 0
        if held:
            yield flush()

    return texts.mapInArrow(send, "bucket int, pack binary")


def combination_rows(texts: DataFrame, p: Join, bits: int, held_once) -> DataFrame:
    """``sig, k1, step, own``: combinations of frequent tokens; ``own`` is the set's share of rare ones in 255ths."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            n = [len(h[0]) for h in held]
            sig = np.concatenate([h[0] for h in held]).view(np.int64)
            rest = (np.repeat(np.array([h[i] for h in held], dtype=kind), n) for i, kind in ((1, np.int64), (2, np.int32), (3, np.int32)))
            return pa.RecordBatch.from_arrays([pa.array(sig), *map(pa.array, rest)], ["sig", "k1", "step", "own"])

        held, total = [], 0
        for key, k, _, many in _signed(batches, p, bits, *held_once.value):
            if len(many):
                held.append((np.unique(many), key[0], _step(len(k)), int((k == 1).sum() * 255 // len(k))))
                total += len(held[-1][0])
            if total >= 1 << 14:
                yield flush()
                held, total = [], 0
        if held:
            yield flush()

    return texts.mapInArrow(send, "sig long, k1 long, step int, own int")


def single_pairs(packed: DataFrame, p: Join, bits: int) -> DataFrame:
    """``sig, a, b`` (``k1`` of sets): pairs that share a rare token (``sig`` null), members of crowded ones (``b`` null)."""
    schema = pa.schema([("sig", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def meet(bucket: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        rec = np.frombuffer(blobs[0], RECORD)
        # A signature of one record meets nobody; most are.
        values, at, n = np.unique(rec["sig"], return_inverse=True, return_counts=True)
        rec = np.unique(rec[n[at] > 1])
        edge = np.flatnonzero(np.concatenate([[True], rec["sig"][1:] != rec["sig"][:-1]])) if len(rec) else np.empty(0, int)
        size = np.diff(np.append(edge, len(rec)))
        crowded = np.repeat(size > p.crowd, size)
        few, many = rec[~crowded], rec[crowded]
        found = [np.empty((0, 2), dtype=np.int64)]
        for d in range(1, p.crowd):
            a, b = few[:-d], few[d:]
            same = a["sig"] == b["sig"]
            if not same.any():
                break
            same &= np.abs(a["step"].astype(int) - b["step"]) <= _apart(p)
            found.append(np.stack([a["k1"][same], b["k1"][same]], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        if len(pairs):
            yield _batch({"sig": [None] * len(pairs), "a": pairs[:, 0], "b": pairs[:, 1]}, schema)
        if len(many):
            sig = (np.int64(bucket) << 32) + many["sig"].astype(np.int64)
            yield _batch({"sig": sig, "a": many["k1"], "b": [None] * len(many)}, schema)

    return _by_bucket(packed, ["pack"], meet, "sig long, a long, b long")


# --- candidates and links ----------------------------------------------------

def _folded(bits: bytes, words: int) -> np.ndarray:
    """The parities of fewer hash values: halves fall on one another."""
    x = np.frombuffer(bits, dtype=np.uint64)
    while len(x) > words:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _may_link(apart: np.ndarray | int, nx: np.ndarray | int, ny: np.ndarray | int, p: Join):
    """Whether sets with so many differing parities can link: they differ in as many tokens at least."""
    return apart * (100 + p.percent) <= (nx + ny) * (100 - p.percent)


def _fit(x: bytes, y: bytes, nx: int, ny: int, p: Join) -> bool:
    if 100 * nx < p.percent * ny or 100 * ny < p.percent * nx:
        return False
    words = min(len(x), len(y)) // 8
    return bool(_may_link(int(np.bitwise_count(_folded(x, words) ^ _folded(y, words)).sum(dtype=np.int64)), nx, ny, p))


def near(pairs: DataFrame, sets: DataFrame, p: Join) -> DataFrame:
    """``a, b`` (vertices, a < b) of the pairs of ``k1`` that sizes and bitmaps leave."""
    end = lambda c: sets.select(F.col("k1").alias(c), *[F.col(x).alias(f"{x}{c}") for x in ("v", "n", "bits")])
    both = pairs.join(end("a"), "a").join(end("b"), "b").where("va != vb").select("va", "vb", "na", "nb", "bitsa", "bitsb")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, x, y = (c.to_pylist() for c in batch.columns)
            good = [i for i in range(len(a)) if _fit(x[i], y[i], na[i], nb[i], p)]
            low, high = [min(a[i], b[i]) for i in good], [max(a[i], b[i]) for i in good]
            yield pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["a", "b"])

    return both.mapInArrow(keep, "a long, b long").distinct()


def verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame, p: Join) -> DataFrame:
    """The pairs ``a, b`` that link, by their whole sets."""
    pairs = written(pairs, "jaccard-near")
    needed = pairs.select(F.col("a").alias("v")).union(pairs.select(F.col("b").alias("v"))).distinct()
    needed = written(sets.select("v", "first_id", *KEY).join(needed, "v", "left_semi"), "jaccard-needed")
    ids = needed.select(F.col("first_id").alias("id")).distinct()

    def tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, tokens in _distinct(batches, p):
            yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([tokens.tobytes()], pa.binary())], ["k1", "k2", "tokens"])

    whole = texts.join(ids, texts.doc_id.eqNullSafe(ids.id), "left_semi").mapInArrow(tokens_of, "k1 long, k2 long, tokens binary")
    # An id with several texts may bring a set twice.
    # Both ends of pairs read one exchange.
    whole = whole.join(needed.select("v", *KEY), KEY).groupBy("v").agg(F.first("tokens").alias("tokens"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= p.percent * (len(x) + len(y) - both):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(good, pa.int32())) for i in (0, 1)], ["a", "b"])

    end = lambda c: whole.select(F.col("v").alias(c), F.col("tokens").alias(f"tokens{c}"))
    return pairs.join(end("a"), "a").join(end("b"), "b").select("a", "b", "tokensa", "tokensb").mapInArrow(check, "a long, b long")


def crowd_pairs(crowd: DataFrame, roots: DataFrame, p: Join, block: int = 256) -> DataFrame:
    """``a, b``: pairs of one signature and two components that the bitmaps leave.

    ``crowd``: ``sig, v, n, bits``. Members lie in blocks by hash; blocks meet pair by pair, and no
    pair is made that the bitmaps exclude. Signatures inside one component are left out.
    """
    placed = crowd.join(roots.withColumnRenamed("u", "v"), "v", "left").withColumn("root", F.coalesce("root", "v"))
    split = placed.groupBy("sig").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("size"))
    split = split.where("r0 != r1").select("sig", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    member = F.struct("v", "root", "n", "bits")
    packs = placed.join(split, "sig").groupBy("sig", F.pmod(F.xxhash64("v"), F.col("blocks")).alias("at"))
    packs = written(packs.agg(F.collect_list(member).alias("m")), "jaccard-blocks")
    left, right = packs.select("sig", F.col("at").alias("x"), F.col("m").alias("mx")), packs.select("sig", F.col("at").alias("y"), F.col("m").alias("my"))
    met = left.join(right, "sig").where("x <= y").select("x", "y", "mx", "my")

    def fields(cell: pa.ListScalar) -> tuple:
        m = cell.values
        v, root, n = (m.field(i).to_numpy() for i in range(3))
        bits = m.field(3).to_pylist()
        return v, root, n, bits, np.stack([_folded(x, BITS // 64) for x in bits])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(2), batch.column(3)):
                (va, ra, na, wa, ba), (vb, rb, nb, wb, bb) = fields(x), fields(y)
                found = []
                for i in range(len(va)):
                    other = np.flatnonzero((rb != ra[i]) & (100 * nb >= p.percent * na[i]) & (100 * na[i] >= p.percent * nb))
                    other = other[_may_link(np.bitwise_count(ba[i] ^ bb[other]).sum(1, dtype=np.int64), na[i], nb[other], p)]
                    other = other[[_fit(wa[i], wb[j], int(na[i]), int(nb[j]), p) for j in other]]
                    found.append(np.stack([np.minimum(va[i], vb[other]), np.maximum(va[i], vb[other])]))
                a, b = np.concatenate(found, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return met.mapInArrow(compare, "a long, b long").distinct()


def _candidates(texts: DataFrame, p: Join, bits: int, held_once) -> tuple[DataFrame, DataFrame]:
    """Pairs ``a, b`` of ``k1``, and the members ``sig, k1`` of crowded signatures."""
    met = written(single_pairs(single_rows(texts, p, bits, held_once), p, bits), "jaccard-singles")
    pairs = met.where("sig IS NULL").select("a", "b")
    combos = written(combination_rows(texts, p, bits, held_once), "jaccard-combinations")
    sizes = combos.groupBy("sig").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    combos = written(combos.join(sizes, "sig"), "jaccard-shared")
    few = combos.where(F.col("size") <= p.crowd).groupBy("sig").agg(F.collect_set(F.struct("k1", "step")).alias("m")).where("size(m) > 1")
    small = few.select(F.explode("m").alias("x"), "m").select("x", F.explode("m").alias("y"))
    small = small.where((F.col("x.k1") < F.col("y.k1")) & (F.abs(F.col("x.step") - F.col("y.step")) <= _apart(p)))
    # Signatures of either kind meet by chance only, which adds candidates.
    crowd = combos.where(F.col("size") > p.crowd).select("sig", "k1", "own").unionByName(
        met.where("sig IS NOT NULL").select("sig", F.col("a").alias("k1"), F.lit(255).alias("own"))
    ).distinct()
    crowd = written(crowd, "jaccard-crowd")
    hubs = crowd.groupBy("sig").agg(F.min(F.struct("own", "k1")).alias("h")).select("sig", F.col("h.k1").alias("b"))
    some = F.array_distinct(F.array(F.min("sig"), F.max("sig"), F.min_by("sig", F.xxhash64("sig"))))
    stars = crowd.groupBy("k1").agg(some.alias("s")).select(F.col("k1").alias("a"), F.explode("s").alias("sig")).join(hubs, "sig")
    pairs = pairs.unionByName(small.select(F.col("x.k1").alias("a"), F.col("y.k1").alias("b"))).unionByName(stars.select("a", "b"))
    return pairs.where("a != b").distinct(), crowd.select("sig", "k1").distinct()


def jaccard_components(df: DataFrame, p: Join = Join(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` (long), one row for each row of ``df``.

    A row's set has the distinct runs of ``words`` words of its text (A-Z in lower case), or all its
    words as one run if they are fewer. ``component_id`` is the smallest id reachable over links
    of ``percent`` Jaccard similarity, its own included.

    Null, empty and wordless texts have an empty set and link with nothing, each its own component.
    Equal texts and repeated rows have one set and so one component. A null id never names a
    component that has another id; a component of null ids only is null. An id with several texts is
    several vertices. An empty table gives an empty one. Texts are taken whole, whatever their
    length. Other columns are left out, so their names cannot clash.
    """
    spark = df.sparkSession
    texts = id_text(df, id_col, text_col)
    docs = written(documents_of(texts, p), "jaccard-documents")
    with_set = docs.where("n > 0")
    sets = with_set.groupBy(*KEY).agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    sets = written(sets.withColumn("v", F.monotonically_increasing_id()), "jaccard-vertices")
    texts = one_each(texts, sets)
    total = docs.agg(F.sum("n").alias("n")).first().n or 0
    bits = min(24, max(8, (total // p.bucket).bit_length()))
    tokens, ks = frequent(written(token_counts(texts, p, bits), "jaccard-counts"), p)
    held_once = spark.sparkContext.broadcast((tokens, ks))  # at most p.table tokens
    pairs, crowd = _candidates(texts, p, bits, held_once)
    links = written(verified(near(pairs, sets, p), sets, texts, p), "jaccard-links")
    roots = components(links, "jaccard-links")
    rest = crowd_pairs(crowd.join(sets, "k1").select("sig", "v", "n", "bits"), roots, p)
    more = written(verified(rest, sets, texts, p), "jaccard-links")
    if not more.isEmpty():
        roots = components(links.unionByName(more), "jaccard-links")
    linked = roots.unionByName(roots.select(F.col("root").alias("u"), "root").distinct()).withColumnRenamed("u", "v")
    named = sets.select(*KEY, "first_id", "v").join(linked, "v", "left").withColumn("root", F.coalesce("root", "v"))
    named = written(named.select(*KEY, "first_id", "root"), "jaccard-named")
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_set = named.join(least, "root").select(*KEY, "component_id")
    found = with_set.join(of_set, KEY).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = docs.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return found.unionByName(alone)
