"""Mixing sources to target weights, by blocks of fixed length.

The words of a source, its documents in a pseudorandom order, are packed into blocks of ``block``
words, or shorter ones where that would make fewer than ``least_blocks``. A mix of ``share`` times all words is made of slots, one block each. Each output shard
draws how many of its slots go to each source from a multinomial distribution, first over hash
groups of sources and then inside each, so no task holds all sources. The slots of a
source are numbered through over the shards; slot ``g`` takes block ``perm(g mod n)`` of its
source's ``n``, with another pseudorandom permutation of the indices (a Feistel network) for each
turn ``g div n``. Blocks are joined by index.

Draws scatter around their mean, so each source's last numbers are settled: what is drawn beyond
its target is let go, and what is missing goes to shards picked by a hash. So a source takes its
target to within half a block, and no block is taken more often than ``ceil(target / size)``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from canopy.llm.common import WORD_CLASS, raw, sliced, written

#: Most slots made from one row.
PIECE = 1 << 16


@dataclass(frozen=True)
class Mix:
    """``weights`` go round over the sources by code point, null last."""

    weights: tuple[float, ...] = (3.0, 1.0, 2.0)
    share: float = 1.5
    most: float = 2.0
    block: int = 64
    least_blocks: int = 32
    shard_slots: int = 4096
    #: Shards grow beyond ``shard_slots`` rather than become more than this.
    most_shards: int = 65536
    #: Sources are drawn in groups of about this many, or of the root of their number if that is more.
    group: int = 4096
    seed: int = 1


def _sizes(df: DataFrame, id_col: str, text_col: str, source_col: str, row: Column | None = None) -> DataFrame:
    """``doc_id, source, key, row, size``; ``key`` orders a source alike on every run."""
    row = F.monotonically_increasing_id() if row is None else row
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    docs = df.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"),
        F.xxhash64(F.col(f"`{id_col}`").cast("long"), text).alias("key"), row.alias("row"),
        text.alias("text"),
    )

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            n = pa.array([len(x.split()) for x in raw(batch.column(4))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], n], ["doc_id", "source", "key", "row", "size"])

    return docs.mapInArrow(counted, "doc_id long, source string, key long, row long, size long")


def targets(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``source, sid, source_size, target, length, blocks, slots`` for every source of ``sizes (source, size)``.

    Targets are ``share`` of all sizes by weight; none exceeds ``most`` times its source's size,
    and the excess is reshared by weight until none is above.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = written(
        totals.orderBy(F.asc_nulls_last("source"))
        .withColumn("part", F.spark_partition_id())
        .withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "mix-sources",
    )
    # One row for each partition of the sort.
    parts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    weights = F.array(*[F.lit(float(w)) for w in mix.weights])
    numbered = placed.join(parts, "part").select("source", "source_size", (F.col("before") + F.col("place")).alias("sid"))
    numbered = numbered.withColumn("weight", F.get(weights, F.pmod("sid", F.lit(len(mix.weights))).cast("int")))
    numbered = written(numbered.withColumn("cap", F.col("source_size") * F.lit(float(mix.most))), "mix-weights")
    wanted = mix.share * float(numbered.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:  # each round caps more sources, or is the last
        above = F.lit(level) * F.col("weight") >= F.col("cap") if capped >= 0 else F.lit(False)
        n, held, weight = numbered.agg(
            F.sum(above.cast("int")), F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("weight")))
        ).first()
        if n == capped or not weight:
            break
        level, capped = (wanted - (held or 0.0)) / weight, n
    target = F.least(F.col("cap"), F.lit(level) * F.col("weight"))
    length = F.greatest(F.lit(1), F.least(F.lit(mix.block), F.floor(F.col("source_size") / F.lit(mix.least_blocks)))).cast("long")
    blocks = F.ceil(F.col("source_size") / length).cast("long")
    slots = F.when(F.col("source_size") > 0, F.round(target * blocks / F.col("source_size")).cast("long")).otherwise(F.lit(0))
    return numbered.select("source", "sid", "source_size", target.alias("target"), length.alias("length"), blocks.alias("blocks"), slots.alias("slots"))


def segments(sizes: DataFrame, sources: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``row, sid, block, word, words``: which words of a row lie in which block of its source.

    The place of a row among its source's words is a running sum in two levels, over hash buckets
    and inside them, so that a source of any size spreads over many tasks.
    """
    rows = sizes.count()
    buckets = max(1, rows >> 12)
    dealt = sizes.withColumn("bucket", F.pmod(F.col("key"), F.lit(buckets)))
    sums = dealt.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).alias("b")
    starts = starts.join(sources.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source"))).select(
        F.col("b.source").alias("source"), "bucket", "start", "sid", "length"
    )
    inner = W.partitionBy("source", "bucket").orderBy("key", "doc_id", "row").rowsBetween(W.unboundedPreceding, -1)
    placed = dealt.withColumn("inside", F.coalesce(F.sum("size").over(inner), F.lit(0))).where("size > 0")
    placed = placed.alias("p").join(
        starts.alias("q"), F.col("p.source").eqNullSafe(F.col("q.source")) & (F.col("p.bucket") == F.col("q.bucket"))
    ).select("row", "sid", "size", "length", (F.col("start") + F.col("inside")).alias("at"))
    b = F.col("length")
    first, last = F.floor(F.col("at") / b), F.floor((F.col("at") + F.col("size") - 1) / b)
    cut = placed.select("row", "sid", "size", "length", "at", F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest("at", F.col("block") * b)
    end = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * b)
    return cut.select("row", "sid", "block", (begin - F.col("at")).alias("word"), (end - begin).alias("words"))


def _mixed(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser of two arrays."""
    with np.errstate(over="ignore"):
        x = (x ^ key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def permuted(index: np.ndarray, n: int, sid: int, turn: int, seed: int) -> np.ndarray:
    """The image of each index below ``n`` under the permutation of (source, turn).

    Four Feistel rounds over the least even number of bits that holds ``n``; an image beyond ``n``
    is permuted again until it falls below, which stays one to one.
    """
    half = max(1, -(-(max(n - 1, 1)).bit_length() // 2))
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = _mixed(np.arange(4, dtype=np.uint64), np.uint64((seed * 1_000_003 + sid * 8191 + turn) % (1 << 63)))
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for key in keys:
            left, right = right, left ^ (_mixed(right, key) & mask)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def slots(sources: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``shard, sid, slot, turn, block``: the mix, one row for each slot."""
    spark = sources.sparkSession
    wanted = sources.where("slots > 0").select("sid", "slots", "blocks")
    many = wanted.count()
    groups = -(-many // max(mix.group, math.isqrt(many)))
    group = F.pmod(F.xxhash64("sid"), F.lit(max(groups, 1))).cast("int")
    # A group's sources are one row: about ``group`` or the root of all, by a hash of distinct numbers.
    members = wanted.groupBy(group.alias("group")).agg(
        F.sum("slots").alias("n"), F.sort_array(F.collect_list(F.struct("sid", "slots"))).alias("members")
    )
    members = written(members, "mix-groups")
    known = sorted(tuple(r) for r in members.select("group", "n").collect())  # at most the root of all sources
    numbers, each = np.array([k[0] for k in known], dtype=np.int32), np.array([k[1] for k in known], dtype=np.int64)
    total = int(each.sum()) if known else 0
    size = max(mix.shard_slots, -(-total // mix.most_shards))
    shards = -(-total // size)
    sent = spark.sparkContext.broadcast((numbers, each / max(total, 1)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salts = -(-parts // max(groups, 1))  # few groups spread their shards over several tasks

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, share = sent.value
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                n = min(size, total - shard * size)
                drawn = np.random.Generator(np.random.PCG64([mix.seed, shard])).multinomial(n, share)
                own = np.flatnonzero(drawn)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers[own]), pa.array(np.full(len(own), shard)), pa.array(drawn[own].astype(np.int64))],
                    ["group", "shard", "n"],
                )

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A group's sources come before the shards that drew it; each shard's draws are dealt to them."""
        sids = share = None
        for batch in batches:
            groups_, drawn_by, counts = (batch.column(i).to_pylist() for i in (0, 2, 3))
            for i, (number, shard, n) in enumerate(zip(groups_, drawn_by, counts)):
                if shard < 0:
                    own = batch.column(4)[i].as_py()
                    sids = np.array([x["sid"] for x in own], dtype=np.int64)
                    share = np.array([x["slots"] for x in own], dtype=np.int64) / n
                    continue
                drawn = np.random.Generator(np.random.PCG64([mix.seed, shard, number + 1])).multinomial(n, share)
                own = np.flatnonzero(drawn)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), shard)), pa.array(sids[own]), pa.array(drawn[own].astype(np.int64))],
                    ["shard", "sid", "n"],
                )

    asked = spark.range(shards).mapInArrow(draw, "group int, shard long, n long")
    asked = asked.select("group", F.pmod("shard", F.lit(salts)).cast("int").alias("salt"), "shard", "n")
    heads = members.select(
        "group", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(-1).cast("long").alias("shard"), "n", "members"
    )
    both = heads.unionByName(asked, allowMissingColumns=True).repartition(parts, "group", "salt")
    drawn = both.sortWithinPartitions("group", "salt", "shard").mapInArrow(inside, "shard long, sid long, n long")
    drawn = written(drawn, "mix-drawn")
    # At most most_shards rows for each source.
    before = W.partitionBy("sid").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    numbered = drawn.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    numbered = numbered.join(wanted, "sid").withColumn("stop", F.least(F.col("start") + F.col("n"), "slots"))
    ranges = numbered.where("stop > start").select("shard", "sid", "blocks", "start", "stop")
    missing = wanted.join(drawn.groupBy("sid").agg(F.sum("n").alias("n")), "sid", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    extra = missing.where("n < slots").select("sid", "blocks", F.explode(F.expr("sequence(n, slots - 1)")).alias("start"))
    extra = extra.select(
        F.pmod(F.xxhash64("sid", "start"), F.lit(max(shards, 1))).alias("shard"), "sid", "blocks", "start",
        (F.col("start") + 1).alias("stop"),
    )
    # One source's ranges leave the window in one partition; cut and dealt, they fill every task.
    cuts = F.explode(F.expr(f"sequence(start, stop - 1, {PIECE})"))
    pieces = ranges.unionByName(extra).withColumn("start", cuts)
    pieces = pieces.withColumn("stop", F.least(F.col("start") + PIECE, "stop")).repartition(parts, "sid", "start")

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, sid, blocks, start, stop in zip(*(c.to_pylist() for c in batch.columns)):
                g = np.arange(start, stop)
                turn = g // blocks
                image = np.empty(len(g), dtype=np.int64)
                for t in np.unique(turn):
                    image[turn == t] = permuted(g[turn == t] % blocks, blocks, sid, int(t), mix.seed)
                same = lambda x: pa.array(np.full(len(g), x, dtype=np.int64))
                yield pa.RecordBatch.from_arrays(
                    [same(shard), same(sid), pa.array(g), pa.array(turn), pa.array(image)],
                    ["shard", "sid", "slot", "turn", "block"],
                )

    return pieces.mapInArrow(filled, "shard long, sid long, slot long, turn long, block long")


def mix_report(
    df: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for each row of ``df``; ``taken`` counts repeats.

    A null text has size zero and gives nothing; rows without a source are a source of their own,
    the last one; null ids and repeated rows are rows like any others; a source without words has
    target zero; an empty table gives an empty one; other columns are left out. A second run
    takes the same.
    """
    sizes = written(_sizes(df, id_col, text_col, source_col), "mix-sizes")
    sources = written(targets(sizes, mix), "mix-targets")
    times = slots(sources, mix).groupBy("sid", "block").agg(F.count(F.lit(1)).alias("times"))
    taken = segments(sizes, sources, mix).join(times, ["sid", "block"])
    taken = taken.groupBy("row").agg(F.sum(F.col("times") * F.col("words")).alias("taken"))
    told = sizes.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select(
        "row", "doc_id", "size", "source_size", "target"
    )
    return told.join(taken, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")
    )


def mixed_documents(
    df: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """The mix as rows with the columns of ``df``: one for each row and turn that takes any of it.

    The text holds the stretches of words that the turn takes, each as it stands in the document
    and joined by line ends; a turn that takes every word of a text gives it unchanged. Rows
    without words (null or empty texts too) can't be taken, and so go. A column ``n_chars`` is set
    to the new length; other columns come back as they are, whatever their names; an empty table
    gives an empty one.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    numbered = written(df.select(F.monotonically_increasing_id().alias("row"), whole.alias("doc")), "mix-documents")
    plain = numbered.select("row", *[F.col(f"doc.`{c}`").alias(n) for c, n in ((id_col, "id"), (text_col, "text"), (source_col, "source"))])
    sizes = written(_sizes(plain, "id", "text", "source", F.col("row")), "mix-sizes")
    sources = written(targets(sizes, mix), "mix-targets")
    chosen = slots(sources, mix).select("sid", "block", "turn")
    taken = segments(sizes, sources, mix).join(chosen, ["sid", "block"])
    # A group is a row's own segments; a row is taken ceil(target / size) times at most.
    taken = taken.groupBy("row", "turn").agg(F.sort_array(F.collect_list(F.struct("word", "words"))).alias("parts"))
    joined = numbered.join(taken.select("row", "parts"), "row").select("doc", "parts")
    names, index = df.columns, df.columns.index(text_col)
    word = re.compile(WORD_CLASS)

    def cut(text: str, parts: list[dict]) -> str:
        runs: list[list[int]] = []
        for p in parts:
            if runs and runs[-1][1] == p["word"]:
                runs[-1][1] += p["words"]
            else:
                runs.append([p["word"], p["word"] + p["words"]])
        places = [m.span() for m in word.finditer(text)]
        if runs == [[0, len(places)]]:
            return text
        return "\n".join(text[places[a][0] : places[b - 1][1]] for a, b in runs)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            columns = batch.column(0).flatten()
            found = [cut(x, y) for x, y in zip(columns[index].to_pylist(), batch.column(1).to_pylist())]
            columns[index] = pa.array(found, columns[index].type)
            if "n_chars" in names:
                at = names.index("n_chars")
                columns[at] = pa.array(map(len, found), pa.int64()).cast(columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(texts, df.schema)
