import base64
import hashlib
import random

import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from regionloom.llm import bpe

PATH = P.path(bpe.VOCABULARY)
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
TIK = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = bpe.Codec(PATH, P.PATTERN, 50)


def test_documents_against_library(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = bpe.op10_byte_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = TIK.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    ids = CODEC.encode(text)
    assert ids == TIK.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


def test_long_pieces():
    rng = random.Random(5)
    for text in ("a" * 3000, "".join(rng.choice("abcdeht") for _ in range(5000)), "ñ" * 999, "=" * 2001):
        assert CODEC.encode(text) == TIK.encode_ordinary(text)


def test_edge_cases(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "Hello  World's\n\n", "z"), (3, "Hello  World's\n\n", "z"), (None, "é" * 40000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.tokenize(df, PATH, P.PATTERN)
    got = bpe.detokenize(out, PATH).collect()
    assert len(got) == 5
    for r in got:
        assert bytes(r["decoded"]) == (r["text"] or "").encode() and r["n_tokens"] == len(r["ids"])
    assert bpe.tokenize(df.limit(0), PATH, P.PATTERN).count() == 0
