import random
import re

import pyarrow as pa
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from canopy.llm import components as K, simhash as S
from tests.llm.cases import nothing, odd


def brute_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_roots(values):
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ordered = sorted(values)
    for i, a in enumerate(ordered):
        for b in ordered[i + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


@given(st.text(max_size=80))
@settings(max_examples=60, deadline=None)
def test_fingerprint(text):
    text = text.encode("utf-8", "ignore").decode()
    assert int.from_bytes(S.fingerprint(text.encode()), "big") == brute_print(text)


def test_long_text_in_slices(monkeypatch):
    text = " ".join(map(str, range(500)))
    monkeypatch.setattr(S, "SHINGLES_AT_ONCE", 7)
    assert int.from_bytes(S.fingerprint(text.encode()), "big") == brute_print(text)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def near(r, n, seeds, flips):
    """Fingerprints around a few seeds, so that cells crowd."""
    out = set()
    while len(out) < n:
        x = r.choice(seeds)
        for _ in range(r.randint(0, flips)):
            x ^= 1 << r.randrange(64)
        out.add(signed(x))
    return sorted(out)


def linked(spark, values):
    nodes = spark.createDataFrame([(v,) for v in values], "fp long")
    roots = {r.u: r.root for r in K.components(S.links(nodes)).collect()}
    return {v: roots.get(v, v) for v in values}


def test_links_against_all_pairs(spark):
    r = random.Random(3)
    seeds = [r.getrandbits(64) for _ in range(12)]
    values = near(r, 500, seeds, 5) + [0, -1, signed(1 << 63), 1, 3, 7]
    assert linked(spark, set(values)) == brute_roots(set(values))


def test_crowded_cells(spark):
    """One bit in each segment: all fall into one cell, which crowds, and the finer grid finds the links."""
    r = random.Random(4)
    values = set()
    for _ in range(150):
        x = [r.randrange(4) for _ in range(16)]
        for _ in range(2):
            values.add(signed(sum(1 << 4 * i + b for i, b in enumerate(x))))
            x[r.randrange(16)] = r.randrange(4)  # two bits away, or none
    assert len(values) > 2 * S.CELL
    roots = linked(spark, values)
    assert roots == brute_roots(values)
    assert len(set(roots.values())) < len(values)


def test_cell_over_many_batches(spark):
    """A cell that goes on over batches is crowded as a whole; small cells beside it are not."""
    rows = sorted([(5, v) for v in range(100, 100 + 3 * S.CELL)] + [(9, 1), (9, 3), (9, 1 << 40), (2, 8)])
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[i : i + 17])], ["cell", "fp"]) for i in range(0, len(rows), 17)]
    out = [tuple(x) for b in S._meet(iter(batches)) for x in zip(*(c.to_pylist() for c in b.columns))]
    assert {a for a, b in out if b is None} == set(range(100, 100 + 3 * S.CELL))
    assert sorted(x for x in out if x[1] is not None) == [(3, 1), (1 << 40, 1)]


def test_chain_is_one_component(spark):
    r = random.Random(5)
    x, values = r.getrandbits(64), []
    for i in range(40):
        values.append(signed(x))
        x ^= 1 << i
    assert set(linked(spark, set(values)).values()) == {min(values)}


def test_components(spark):
    r = random.Random(6)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(60)] + [(7, 7)]
    parent = {v: v for e in edges for v in e}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {x.u: x.root for x in K.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {v: got.get(v, v) for v in parent} == {v: find(v) for v in parent}
    assert K.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(spark):
    df = odd(spark)
    rows = df.collect()
    got = S.near_duplicates(df).collect()
    assert len(got) == len(rows)
    prints = {x.text: brute_print(x.text or "") for x in rows}
    roots = brute_roots({signed(p) for p in prints.values()})
    least = {}
    for x in rows:
        root = roots[signed(prints[x.text])]
        least[root] = min((i for i in (least.get(root), x.doc_id) if i is not None), default=None)
    want = sorted(((x.doc_id, f"{prints[x.text]:016x}", least[roots[signed(prints[x.text])]]) for x in rows), key=str)
    assert sorted((tuple(x) for x in got), key=str) == want
    assert S.near_duplicates(nothing(spark)).count() == 0


def test_one_of_each_group_stays(spark):
    df = odd(spark)
    kept = S.drop_near_duplicates(df)
    assert kept.schema == df.schema
    rows = kept.collect()
    parts = brute_roots({signed(brute_print(x.text or "")) for x in df.collect()})
    assert len(rows) == len(set(parts.values()))
    assert sum(x.text == df.where("doc_id = 5").first().text for x in rows) == 1


def test_clashing_columns(spark):
    names = ["__fp", "__id", "__keep", "fp", "keep_id", "keep_fp"]
    df = odd(spark).drop("fp").select("*", *[F.concat(F.lit(f"{n} of "), F.coalesce("text", F.lit(""))).alias(n) for n in names])
    kept = S.drop_near_duplicates(df)
    assert kept.columns == df.columns
    rows = kept.collect()
    assert len(rows) == S.drop_near_duplicates(odd(spark)).count()
    assert all(x[n] == f"{n} of {x.text or ''}" for x in rows for n in names)
    assert S.drop_near_duplicates(nothing(spark)).count() == 0
