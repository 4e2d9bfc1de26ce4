import base64
import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from canopy.llm import bpe
from tests.llm.cases import by_key, nothing, odd

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("test", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=200))
@settings(max_examples=150, deadline=None)
def test_round_trip(library, text):
    codec = bpe.codec(PATH, P.PATTERN)
    ids = codec.encode(text)
    assert ids == library.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


@pytest.mark.parametrize("piece", ["a" * 3000, "ab" * 700 + "c", "日本語" * 200, "thequickbrown" * 60, "0" * 129, "x" * 65])
def test_long_pieces(library, piece):
    assert bpe.codec(PATH, P.PATTERN).encode(piece) == library.encode_ordinary(piece)


@pytest.mark.parametrize("chunk, overlap", [(64, 8), (300, 40), (1000, 900)])
def test_chunks(spark, library, chunk, overlap):
    """Runs longer than the overlap, contractions and white space at the edges, null and repeated ids."""
    texts = ["a" * 5000, " " * 3000 + "x", "don't we'll they've " * 300, "\n\n  é日本" * 300, "1234 ab'" * 500 + "zz" * 900, None, ""]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[2])]
    got = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), PATH, P.PATTERN, chunk=chunk, overlap=overlap)
    assert by_key((x.doc_id, list(x.ids)) for x in got.collect()) == by_key((i, library.encode_ordinary(t or "")) for i, t in rows)


def test_digests(spark, library):
    df = odd(spark)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = []
    for x in df.collect():
        ids = library.encode_ordinary(x.text or "")
        want.append((x.doc_id, len(ids), sha(" ".join(map(str, ids)).encode()), sha((x.text or "").encode())))
    assert by_key(bpe.round_trip(df, PATH, P.PATTERN).collect()) == by_key(want)
    assert bpe.round_trip(nothing(spark), PATH, P.PATTERN).count() == 0


def test_decode(spark):
    df = odd(spark)
    back = bpe.decode(bpe.encode(df, PATH, P.PATTERN), PATH)
    assert by_key((x.doc_id, bytes(x.bytes)) for x in back.collect()) == by_key((x.doc_id, (x.text or "").encode()) for x in df.collect())


def test_overlap_must_fit(spark):
    with pytest.raises(ValueError):
        bpe.encode(odd(spark), PATH, P.PATTERN, chunk=10, overlap=10)
