import base64
import hashlib
from collections import Counter

import corpus_pipeline
import duckdb
import public_tokenizers as P
import tiktoken
from regionloom.llm import bpe, lines, mixing, quality

from .test_similar import plain_keepers

SF = "/root/testdata/sf0.001"


def plain_pipeline(docs, labels):
    """The stages by DuckDB SQL, dictionaries and a tokenizer library."""
    con = duckdb.connect()
    con.register("documents", docs)
    con.register("labels", labels)
    kept = {r[0] for r in con.sql(f"SELECT doc_id FROM ({quality.OP2_SQL}) WHERE kept").fetchall()}
    docs = docs[docs.doc_id.isin(kept)].copy()
    con.register("documents", docs)
    digests = dict(con.sql(f"SELECT doc_id, kept_sha256 FROM ({lines.OP5_SQL})").fetchall())
    first = {}
    texts = {}
    for i, t in sorted(zip(docs.doc_id, docs.text)):
        out = []
        for line in t.split("\n"):
            key = line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
            if len(key) < 10 or first.setdefault(key, i) == i:
                out.append(line)
        texts[i] = "\n".join(out)
        assert hashlib.sha256(texts[i].encode()).hexdigest() == digests[i]
    docs["text"] = docs.doc_id.map(texts)
    stay = plain_keepers(list(texts.items()))
    docs = docs[docs.doc_id.isin(stay)].copy()
    con.register("documents", docs)
    mixed = con.sql(mixing.OP1_SQL).fetchall()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(bpe.VOCABULARY), "rb"))}
    tik = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = Counter()
    for i, size, _, _, taken in mixed:
        ids = tik.encode_ordinary(texts[i])
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        out[i, len(ids), digest, hashlib.sha256(texts[i].encode()).hexdigest()] += taken // size if size else 0
    return +out


def test_pipeline_against_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    rows = corpus_pipeline.run(spark, SF).where("n_tokens > 0").collect()
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows)
    want = Counter({k: v for k, v in plain_pipeline(docs, labels).items() if k[1]})
    assert got == want
    assert all(len(r["ids"]) == r["n_tokens"] for r in rows)


def test_stages_keep_columns_and_survive_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept boolean"
    prose = "the quick brown fox jumps over the lazy dog while many other animals look on from the old wooden fence near the river bank today"
    rows = [(1, prose, "en", "a", 9, True), (1, prose, "en", "a", 9, True), (None, prose + " again", None, None, None, None), (None, None, None, None, None, None)]
    rows += [(3, "", "en", "b", 0, False), (4, "x " * 40000, "en", "b", 1, False), (5, prose + " and so on and on until night fell", "en", "a", 5, None)]
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(1, 1, 0), (None, 1, None), (5, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for source in (docs, docs.limit(0)):
        now = source
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, str(tmp_path))
            assert now.columns == docs.columns
            now = spark.createDataFrame(now.collect(), schema)
        out = corpus_pipeline.byte_bpe(spark, now, str(tmp_path)).collect()
        assert bool(out) == (source is docs)
