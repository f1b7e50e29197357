"""Nulls, empty and long texts, ties, repeats, empty tables and clashing columns, operator by operator."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F
from regionloom.llm import bpe, langid, lines, media, mixing, quality, urls

ROWS = [
    (1, "the cat sat on the mat", "b"),
    (1, "the cat sat on the mat", "b"),
    (2, None, "a"),
    (3, "", "a"),
    (4, "x " * 30000, "c"),
    (None, "no id here at all", None),
    (None, "no id here at all", None),
    (5, "tie tie tie", "c"),
    (6, "tie tie tie", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumn("size", F.lit("mine"))


def test_mixing(spark, docs):
    out = mixing.mix_sources(docs).collect()
    assert len(out) == len(ROWS) and out[0].size is not None
    by = {r["source"]: r for r in out}
    assert by["a"]["target"] == 0 and by["a"]["source_size"] == 0  # only empty texts
    assert all(r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2 for r in out)
    total = sum(r["size"] for r in out)
    assert sum(r["target"] for r in {r["source"]: r for r in out}.values()) == pytest.approx(1.5 * total)
    assert [tuple(sorted(map(str, r))) for r in sorted(out, key=str)] == [tuple(sorted(map(str, r))) for r in sorted(mixing.mix_sources(docs).collect(), key=str)]
    slim = mixing.mix_sources(docs, keep_text=False)
    assert sorted((str(r["doc_id"]), r["taken"]) for r in slim.collect()) == sorted((str(r["doc_id"]), r["taken"]) for r in out)
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    assert mixing.repeat_rows(mixing.mix_sources(docs), ["doc_id"]).count() == sum(r["copies"] for r in out)


def test_mixing_comes_near_targets(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(1, 40), f"s{min(9, int(rng.expovariate(0.5)))}") for i in range(3000)]
    out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s in {r["source"] for r in out}:
        mine = [r for r in out if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 20  # half the largest document
        assert mine[0]["target"] <= 2 * mine[0]["source_size"]


def test_mixing_splits_repeated_rows_at_the_cut(spark):
    rows = [(1, "a " * 100, "s", i % 3) for i in range(400)] + [(i, "b " * 10, "t", 0) for i in range(2, 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, epochs int")
    one = mixing.mix_sources(df, (1.0, 1.0), 0.75).collect()
    assert len(one) == len(rows) and {r["epochs"] for r in one} == {0, 1, 2}
    for s, half in (("s", 50), ("t", 5)):
        mine = [r for r in one if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= half
    for slim in (mixing.mix_sources(df, (1.0, 1.0), 0.75), mixing.mix_sources(df.repartition(7), (1.0, 1.0), 0.75)):
        assert sorted((r["doc_id"], r["epochs"], r["taken"]) for r in slim.collect()) == sorted((r["doc_id"], r["epochs"], r["taken"]) for r in one)
    slim = mixing.mix_sources(df, (1.0, 1.0), 0.75, keep_text=False).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in slim) == sorted((r["doc_id"], r["taken"]) for r in one)


def test_mixing_of_symbols_and_internal_names(spark):
    """Symbol-heavy texts have small weights and large keys; columns named as the operator's own stay."""
    names = "rest edge inside key bits head row last in id n fit before source_key size_ _copy time".split()
    rows = [(i, "# $ % & | < > " * (1 + i % 5), "s", *range(len(names))) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` int" for n in names))
    out = mixing.mix_sources(df, (1.0,), 0.5)
    got = out.collect()
    assert [tuple(r[n] for n in names) for r in got] == [tuple(range(len(names)))] * 500
    assert abs(sum(r["taken"] for r in got) - got[0]["target"]) <= 20
    assert mixing.repeat_rows(out, df.columns).columns == df.columns


def test_water_filling(spark):
    sizes = spark.createDataFrame([("sa", 10), ("sb", 1000), ("sc", 10)], "source_key string, source_size long")
    got = {r["source_key"]: r["target"] for r in mixing.source_targets(sizes, (3.0, 1.0, 2.0), 1.5, 2).collect()}
    assert got == {"sa": 20.0, "sc": 20.0, "sb": 1490.0}


def test_quality(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (None, 1, 0), (5, 1, 1), (6, 1, None)], "doc_id long, quality int, toxic int")
    assert sorted(r[0] for r in quality.trusted_ids(labels).collect()) == [1, 6]
    named = docs.withColumn("kept", F.lit("x"))
    ratio = quality.fit_log_ratio(docs, labels)
    out = quality.judge(named, ratio).collect()
    assert len(out) == len(ROWS) and {type(r["kept"]) for r in out} == {bool}
    empty = [r for r in out if r["doc_id"] in (2, 3)]
    assert all(r["n_words"] == 0 and r["base_failed"] and r["llr"] == 0 for r in empty)
    long = next(r for r in out if r["doc_id"] == 4)
    assert long["n_words"] == 30000 and long["n_repeat_words"] == 30000 and long["base_failed"]
    assert quality.judge(docs.limit(0), ratio).count() == 0
    assert abs(quality.fit_log_ratio(docs, labels.limit(0))).max() < 20


def test_quality_repeats():
    text = " ".join(f"w{i}" for i in range(12))
    n = quality._surface([f"{text} {text}".encode(), text.encode(), b"", "é * \t|".encode()])
    assert [list(map(int, x)) for x in n] == [[24, 12, 0, 3], [n[1][0], n[1][0] // 2, 0, 3], [0, 0, 0, 2], [24, 0, 0, 0]]
    assert quality.dup_lines("a\n\n \na\nb") == 1


def test_quality_repeats_of_words_with_equal_weak_hashes():
    """Thue-Morse words agree with their complements under polynomial hashes modulo 2^64; windows of them do not repeat."""
    word = "a"
    while len(word) < 1024:
        word += word.translate({97: 98, 98: 97})
    other = word.translate({97: 98, 98: 97})
    rest = [f"w{i}" for i in range(7)]
    assert quality._surface([" ".join([word, *rest, "x", other, *rest]).encode()])[3][0] == 0
    assert quality._surface([" ".join([word, *rest, "x", word, *rest]).encode()])[3][0] == 16


def test_lines(spark, docs):
    shared = "A line that is long enough"
    rows = [(5, f"{shared}\nown\n{shared}"), (3, f"  {shared.upper()} \nx"), (9, f"{shared}\n{shared}"), (None, f"{shared}\nlast of all lines"), (None, "last of all lines"), (7, None), (8, ""), (9, f"{shared}\n{shared}"), (4, "short\nshort"), (6, "short")]
    rows.append((10, "\n".join(f"line number {i % 700} of many" for i in range(20000))))
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, n_lines string")
    for batches, fanout in ((4, 2), (1, 3)):
        got = {(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"][:40]) for r in lines.dedup_lines(df, batches, fanout).collect()}
        assert (3, 2, 0, f"  {shared.upper()} \nx") in got and (5, 3, 2, "own") in got and (9, 2, 2, "") in got
        assert (None, 2, 1, "last of all lines") in got and (None, 1, 0, "last of all lines") in got
        assert (7, 1, 0, "") in got and (8, 1, 0, "") in got and (4, 2, 0, "short\nshort") in got
        assert any(r[:3] == (10, 20000, 0) for r in got)
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_lines_of_later_deliveries(spark):
    rows = [(i, f"shared line {i % 7} of many\nown line of document {i}") for i in range(40)]
    schema = "doc_id long, text string"
    whole = {r["doc_id"]: r["kept_text"] for r in lines.dedup_lines(spark.createDataFrame(rows, schema)).collect()}
    got = {}
    try:
        for a in range(0, 40, 10):
            part = lines.dedup_lines(spark.createDataFrame(rows[a : a + 10], schema), 2, 2, name="deliveries")
            got |= {r["doc_id"]: r["kept_text"] for r in part.collect()}
        names = [r["tableName"] for r in spark.sql("SHOW TABLES LIKE 'deliveries_*'").collect()]
        assert got == whole and 0 < len(names) <= 4
    finally:
        for r in spark.sql("SHOW TABLES LIKE 'deliveries_*'").collect():
            spark.sql(f"DROP TABLE {r['tableName']}")
    assert not spark.sql("SHOW TABLES LIKE 'line_run_*'").collect()


def test_runs_are_joined_in_their_order(spark):
    runs = lines.Runs(spark)
    try:
        keys = spark.range(1000).select(F.col("id").alias("h1"), F.col("id").alias("h2"), F.col("id").alias("first"), F.col("id").alias("last"))
        runs.add(keys)
        again = keys.repartition(runs.buckets, *lines.KEY).join(runs._run(runs.levels[0][0]).hint("merge"), lines.KEY)
        plan = again._jdf.queryExecution().executedPlan().toString()
        side = plan[plan.index("FileScan") - 400 : plan.index("FileScan")]
        assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1, side
    finally:
        runs.close()


def test_lines_keep_columns_of_internal_names(spark):
    names = "gone lines row _id _th _text pos h1 h2 batch keeper fresh".split()
    df = spark.createDataFrame([(i, "a line of many words", *range(len(names))) for i in range(3)], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    out = lines.dedup_lines(df).collect()
    assert [tuple(r[n] for n in names) for r in out] == [tuple(range(len(names)))] * 3 and sorted(r["n_dropped"] for r in out) == [0, 1, 1]


def test_media_rows(spark, docs):
    out = media.round_trip(docs).collect()
    assert len(out) == len(ROWS)
    for r, (_, text, _) in zip(out, ROWS):
        n, payload = media.padded(text)
        assert (r["n_bytes"], r["payload_bytes"]) == (n, len(payload)) and r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
    assert media.round_trip(docs.limit(0)).count() == 0
    probed = media.probe_media(media.encode_media(docs)).collect()
    assert [bytes(r["payload"]) for r in probed] == [media.padded(t)[1] for _, t, _ in ROWS]
    assert media.probe_media(docs.select(F.lit(None).cast("binary").alias("media"))).first()["feature"] is None


def test_media_streams():
    rng = random.Random(4)
    payload = bytes(rng.randrange(256) for _ in range(9000)) + b"\xff\xfb\x90\x00" * 40
    stream = media.write_stream(payload)
    s = media.read_stream(stream)
    assert media.payload_of(s) == payload and s.crc_bad == 0 and s.skipped == 0 and s.table == "Xing" and s.table_frames == s.frames == len(s.offsets)
    assert s.duration == media.Fraction(1152 * s.frames, 32000)
    assert all(stream[o : o + 2] == b"\xff\xfa" for o in s.offsets)
    start = s.offsets[0]
    broken = bytearray(stream)
    broken[start + 10] ^= 1  # side information
    assert media.read_stream(bytes(broken)).crc_bad == 1
    junk = stream[: s.offsets[1]] + b"junk\xff\xfb\x00" * 9 + stream[s.offsets[1] :] + b"TAG" + b"a title".ljust(125, b"\x00")
    j = media.read_stream(junk)
    assert j.skipped == 63 and j.frames == s.frames and j.tags["id3v1"] == "a title" and media.payload_of(j) == payload
    assert media.read_stream(b"").frames == 0 and media.read_stream(b"\xff" * 500).frames == 0
    plain = bytes((0xFF, 0xFB, 0x90, 0x64))  # MPEG-1 Layer III, 128 kbit/s, 44.1 kHz, joint stereo, no CRC
    h = media.parse_header(plain)
    assert (h.kbps, h.rate, h.length, h.samples, h.side, h.mono) == (128, 44100, 417, 1152, 32, False)


def test_urls(spark):
    cases = ["https://www.Example.com/en/1", "http://example.com/en/", "http://example.com/en", "http://a.net/fr/x?y", "http://a.net/de", "x", None, "http://", "https://EXAMPLE.com", "a://b.net/es/#f", "http://notexample.com/en/1", "http://www.example.com/en/1"]
    df = spark.createDataFrame([(i, u, "r") for i, u in enumerate(cases)], "page_id long, url string, rule string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.filter_urls(df, urls.RULES).collect()}
    assert [got[i] for i in range(12)] == [
        ("www.example.com/en/", "allow"), ("example.com/en/", "block"), ("com/", "allow"), ("net/fr/", "block"), (None, "allow"), (None, "allow"),
        (None, "allow"), (None, "allow"), (None, "allow"), ("net/es/", "block"), ("com/", "allow"), ("www.example.com/en/", "allow"),
    ]
    rules = [*urls.RULES, ("block", "com", "/p"), ("allow", "a.com", "/pq/r"), ("block", "a.com", "/pq/r"), ("block", "", "/"), ("allow", "net", "")]
    more = spark.createDataFrame([(i, u) for i, u in enumerate([*[c for c in cases if c], "http://a.com/pq/rst", "http://b.com/pq", "http://c.net", "://x"])], "page_id long, url string")
    a = sorted(map(tuple, urls.filter_urls(more, rules).collect()), key=str)
    assert a == sorted(map(tuple, urls.filter_urls(more, rules, max_bytes=0).select(*urls.filter_urls(more, rules).columns).collect()), key=str)
    assert urls.filter_urls(df.limit(0), urls.RULES).count() == 0 and urls.filter_urls(df, []).where("verdict <> 'allow'").count() == 0


def test_empty_tables_long_texts_and_clashing_names(spark):
    import public_tokenizers

    rows = [(1, "wörd " * 1_000_000, "de"), (2, "short words here", "en"), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"n_bytes": F.lit("mine"), "n_tokens": F.lit("x"), "score": F.lit("y")})
    got = {r["doc_id"]: r for r in media.round_trip(docs).collect()}
    assert got[1]["n_bytes"] == 6_000_000 and got[1]["payload_sha256"] == hashlib.sha256(media.padded(rows[0][1])[1]).hexdigest() and got[3]["n_bytes"] == 0
    path = public_tokenizers.path(bpe.VOCABULARY)
    n = {r["doc_id"]: r["n_tokens"] for r in bpe.tokenize(docs, path, public_tokenizers.PATTERN, ("n_tokens",), False).collect()}
    assert n[1] == 3_000_001 and n[3] == 0 and bpe.tokenize(docs.limit(0), path, public_tokenizers.PATTERN).count() == 0
    model = langid.fit(docs)
    said = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, model).collect()}
    assert said[1] == "de" and said[2] in ("de", "en") and said[3] == "und" and langid.predict(docs.limit(0), model).count() == 0
    nothing = langid.fit(docs.limit(0))
    assert {(r["lang_pred"], r["score"]) for r in langid.predict(docs, nothing).collect()} == {("und", 0.0)}
