"""Registration, SQL checks, and the pipeline against a plain one."""

import re

import pytest

import __spark_entry__
import corpus_pipeline
from canopy.llm import bpe, quality_rules, registry, secret_scan, simhash
from canopy.llm.common import read
from registry.check import compare, duck
from tests.conftest import DATA
from tests.llm.cases import by_key


def test_names():
    names = list(__spark_entry__.queries())
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(registry.ORACLES) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_sql(spark, name):
    con = duck(DATA)
    df = registry.QUERIES[name](spark, DATA)
    rel = con.execute(registry.ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    assert compare([tuple(r) for r in df.select(*names).collect()], [tuple(r) for r in rel.fetchall()]) == ""


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_whole_table(spark, name):
    df = registry.QUERIES[name](spark, DATA)
    if "doc_id" in df.columns:
        want = [r.doc_id for r in read(spark, DATA, "documents").collect()]
        assert sorted(r.doc_id for r in df.select("doc_id").collect()) == sorted(want)
    else:
        assert df.count()


def test_pipeline(spark):
    """Stage by stage on the driver: what is kept, what is cut, and what ids come out."""
    docs = read(spark, DATA, "documents").collect()
    judge = quality_rules.Judge(quality_rules.Bands())
    good = [d for d in docs if judge(d.text or "")[6]]
    kept = corpus_pipeline.quality(spark, read(spark, DATA, "documents"), DATA)
    assert by_key(kept.collect()) == by_key(good)
    group = {r.doc_id: r.component_id for r in simhash.near_duplicates(kept).collect()}
    single = [d for d in good if group[d.doc_id] == d.doc_id]
    stayed = corpus_pipeline.near_duplicates(spark, kept, DATA)
    assert by_key(stayed.collect()) == by_key(single)
    clean = corpus_pipeline.secrets(spark, stayed, DATA)
    told = {r.doc_id: r for r in clean.collect()}
    assert len(told) == len(single)
    machine = secret_scan.automaton(secret_scan.RULES)
    for d in single:
        assert told[d.doc_id].n_chars == len(told[d.doc_id].text)
        spans = machine.spans([d.text.encode()])[0]
        assert told[d.doc_id].text == d.text if not spans else not machine.spans([told[d.doc_id].text.encode()])[0]
    got = corpus_pipeline.run(spark, DATA)
    assert got.columns == ["doc_id", "ids"]
    import public_tokenizers

    back = bpe.decode(got, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()
    for r in back:
        text = bytes(r.bytes).decode()
        assert all(line in told[r.doc_id].text for line in text.split("\n"))
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    taken = sum(words(bytes(r.bytes).decode()) for r in back)
    assert taken == pytest.approx(1.5 * sum(words(d.text) for d in told.values()), rel=0.02)


def test_stages_keep_columns(spark):
    docs = read(spark, DATA, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == corpus_pipeline.COLUMNS
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
