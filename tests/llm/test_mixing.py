from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopy.llm import mixing as X
from canopy.llm.common import written
from tests.conftest import DATA
from tests.llm.cases import nothing, odd


def size(text):
    return len((text or "").encode().split())


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """By hand: cap, reshare by weight, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), set(order), {}
    while free:
        total = sum(weight[s] for s in free)
        above = {s for s in free if left * weight[s] / total > most * sizes[s]}
        if not above:
            out |= {s: left * weight[s] / total for s in free}
            break
        for s in above:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in above)
        free -= above
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1000, 4097])
def test_permutation(n):
    for turn in (0, 1):
        image = X.permuted(np.arange(n), n, 3, turn, 1)
        assert sorted(image.tolist()) == list(range(n))
    if n > 64:
        assert (X.permuted(np.arange(n), n, 3, 0, 1) != X.permuted(np.arange(n), n, 3, 1, 1)).any()


def check(spark, df, near):
    rows = df.collect()
    got = X.mix_report(df)
    told = got.collect()
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"] and len(told) == len(rows)
    sizes = defaultdict(int)
    for x in rows:
        sizes[x.source] += size(x.text)
    want = targets(sizes)
    assert sorted((str(x.doc_id), size(x.text), sizes[x.source]) for x in rows) == sorted((str(x.doc_id), x.size, x.source_size) for x in told)
    by_size = defaultdict(int)
    for x in told:
        by_size[x.source_size, round(x.target, 6)] += x.taken
        assert x.taken <= 2 * x.size
    for s, n in sizes.items():
        assert any(k[0] == n and k[1] == pytest.approx(want[s]) for k in by_size)
    assert all(abs(n - k[1] * sum(v == k[0] for v in sizes.values())) <= near for k, n in by_size.items() if len(set(sizes.values())) == len(sizes))
    assert sorted(map(str, told)) == sorted(map(str, X.mix_report(df).collect()))


def test_given_table(spark):
    check(spark, spark.read.parquet(f"{DATA}/documents.parquet"), 130)


def test_odd_rows(spark):
    check(spark, odd(spark), 130)
    assert X.mix_report(nothing(spark)).count() == 0
    empty = odd(spark).where("doc_id in (1, 2)")
    assert [(x.size, x.target, x.taken) for x in X.mix_report(empty).collect()] == [(0, 0.0, 0)] * 2


def test_small_sources(spark):
    """Sources of few words take their targets too: to within a block, which is a small share of them."""
    n = [1, 5, 30, 63, 64, 65, 100, 190, 500, 5000]
    df = spark.createDataFrame([(i, " ".join(["w"] * k), f"s{i:02}") for i, k in enumerate(n)], "doc_id long, text string, source string")
    mix = X.Mix(share=0.0818, weights=(1.0,))
    told = X.mix_report(df, mix).collect()
    assert any(0 < x.target < 0.5 * x.size for x in told) and any(0.5 * x.size < x.target < 1.9 * x.size for x in told)
    for x in told:
        assert abs(x.taken - x.target) <= 1 + x.size / 32 and x.taken <= 2 * x.size
    texts = {x.doc_id: 0 for x in told}
    for x in X.mixed_documents(df, mix).collect():
        texts[x.doc_id] += size(x.text)
    assert texts == {x.doc_id: x.taken for x in told}


@pytest.mark.parametrize("group", [4096, 7])
def test_slots_by_groups(spark, group):
    """Any number of sources: drawn by groups, each has its slots once, over all shards in their sizes."""
    sources = spark.range(1000).selectExpr("id AS sid", "1 + id % 9 AS slots", "1 + id % 5 AS blocks")
    rows = X.slots(sources, X.Mix(group=group, shard_slots=100)).collect()
    got, shards = defaultdict(list), defaultdict(int)
    for x in rows:
        got[x.sid].append(x.slot)
        shards[x.shard] += 1
    assert {i: list(range(1 + i % 9)) for i in range(1000)} == {i: sorted(x) for i, x in got.items()}
    assert len(shards) == 50 and max(shards.values()) < 200 and min(shards.values()) > 40


def test_segments_and_slots(spark):
    """Blocks are full but for a source's last; every slot's block exists, at most twice in all."""
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    mix = X.Mix(block=16, shard_slots=50)
    sizes = written(X._sizes(df, "doc_id", "text", "source"), "t")
    sources = written(X.targets(sizes, mix), "t")
    fill = defaultdict(int)
    for x in X.segments(sizes, sources, mix).collect():
        fill[x.sid, x.block] += x.words
    blocks = {x.sid: x for x in sources.collect()}
    for (sid, b), n in fill.items():
        last = b == blocks[sid].blocks - 1
        assert n == (blocks[sid].source_size - 16 * b if last else 16)
    assert len(fill) == sum(x.blocks for x in blocks.values())
    taken, shards = defaultdict(int), set()
    for x in X.slots(sources, mix).collect():
        taken[x.sid, x.block] += 1
        shards.add(x.shard)
    assert set(taken) <= set(fill) and max(taken.values()) <= 2 and len(shards) > 5
    got = defaultdict(int)
    for (sid, _), n in taken.items():
        got[sid] += n
    assert all(got[sid] == x.slots for sid, x in blocks.items())


@pytest.mark.parametrize("table", ["given", "odd"])
def test_documents_of_the_mix(spark, table):
    df = spark.read.parquet(f"{DATA}/documents.parquet") if table == "given" else odd(spark)
    mixed = X.mixed_documents(df)
    assert mixed.columns == df.columns
    taken, told = defaultdict(int), defaultdict(int)
    texts = defaultdict(set)
    for x in df.collect():
        texts[x.doc_id].add(x.text)
    for x in mixed.collect():
        taken[x.doc_id] += size(x.text)
        assert any(all(line in t for line in x.text.split("\n")) for t in texts[x.doc_id] if t)
    for x in X.mix_report(df).collect():
        told[x.doc_id] += x.taken
    assert {k: n for k, n in told.items() if n} == dict(taken)
    assert X.mixed_documents(nothing(spark)).count() == 0


def test_one_source_fills_every_task(spark):
    """All slots of one source: no partition holds more than twice its share, and none is lost."""
    sources = spark.createDataFrame(
        [("a", 0, 6_000_000, 9_000_000.0, 64, 93_750, 140_625)],
        "source string, sid long, source_size long, target double, length long, blocks long, slots long",
    )
    made = X.slots(sources)
    by_part = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(by_part) == made.select("slot").distinct().count() == 140_625
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(by_part) == parts and max(by_part) <= 2 * 140_625 / parts


def test_clashing_columns(spark):
    """Columns named like helpers come back as they are."""
    names = ["__row", "__parts", "row", "parts", "doc", "turn", "id", "size", "key"]
    df = odd(spark).drop("row").select("*", *[F.concat(F.lit(f"{n} of "), F.coalesce("text", F.lit(""))).alias(n) for n in names])
    mixed = X.mixed_documents(df)
    assert mixed.columns == df.columns
    texts = {x.text for x in df.collect()}
    rows = mixed.collect()
    assert rows
    for x in rows:
        assert all(x[n].startswith(f"{n} of ") and x[n].removeprefix(f"{n} of ") in texts for n in names)
