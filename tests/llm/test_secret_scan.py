import hashlib
import random
import re

import pytest

from canopy.llm import secret_scan as S
from tests.llm.cases import by_key, nothing, odd

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def base(spans):
    return [s for s in spans if s[1] < 3]


def test_against_backtracking():
    r = random.Random(7)
    bits = ["password", "PassWd", "secret", "token", "api_key", "apikey", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH01234567",
            "0123456789abcdef", "é", "\n", "x", "Z9+/", "token=", "tokenABC", "secre"]
    texts = ["".join(r.choices(bits, k=r.randint(0, 50))) for _ in range(3000)]
    found = S.automaton(S.RULES).spans([t.encode() for t in texts])
    assert [base(f) for f in found] == [brute(t) for t in texts]


def test_lanes_and_blocks(monkeypatch):
    """Runs longer than lanes and blocks come out whole."""
    monkeypatch.setattr(S, "BLOCK_LANES", 4)
    monkeypatch.setattr(S, "BLOCK_STEPS", 16)
    texts = ["0123456789abcdef" * 40, "x token=" + "b" * 300 + " AKIA" + "Q" * 90, "", "plain", "password='" + "k" * 65]
    machine = S.Automaton(S.RULES)
    assert [base(f) for f in machine.spans([t.encode() for t in texts])] == [brute(t) for t in texts]


def test_added_kinds():
    texts = ["a ghp_" + "Ab1" * 12 + " b", "xoxb-123456789012", "-----BEGIN RSA PRIVATE KEY-----", "eyJabc.eyJdef.0123456789abcdef_"]
    kinds = [[S.RULES[r].kind for _, r, _ in f] for f in S.automaton(S.RULES).spans([t.encode() for t in texts])]
    assert [k[0] for k in kinds] == ["github", "slack", "private_key", "jwt"]


@pytest.mark.parametrize("pattern", ["a", "ab(?:cd)?", "[^a]bc", "é{3}"])
def test_refused(pattern):
    with pytest.raises(ValueError):
        S.Automaton([S.Rule("x", pattern)])


def test_odd_rows(spark):
    df = odd(spark).unionByName(spark.createDataFrame([(20, "é token = abcdefghijkl!", "a", "r", 1, "w")], odd(spark).schema))
    got = S.secret_report(df)
    assert got.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    rows = got.collect()
    assert len(rows) == df.count()
    row = next(x for x in rows if x.doc_id == 20)
    assert (row.n_assign, row.spans) == (1, "assign:2:22")
    assert row.base_sha256 == hashlib.sha256(b"assign:2:22").hexdigest()
    assert all(x.base_sha256 == hashlib.sha256(b"").hexdigest() for x in rows if not x.spans)
    assert S.secret_report(nothing(spark)).count() == 0


def test_redaction(spark):
    rows = [(1, "x token=abcdefghijkl y 0123456789abcdef", None, None, None, None), (2, None, None, None, None, None), (3, "é", None, None, None, None)]
    df = spark.createDataFrame(rows, odd(spark).schema)
    got = by_key(S.redact_secrets(df).select("doc_id", "text").collect())
    assert got == [(1, "x <assign> y <hex>"), (2, None), (3, "é")]
