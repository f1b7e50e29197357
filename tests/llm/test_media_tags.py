import pytest
from regionloom.llm import media as M


def with_tag_at_128(n):
    """A text of n characters whose stream has TAG 128 bytes before the end, or None if padding or a head is there."""
    data = M.write_stream(b"x" * n)
    at = n - (128 - (len(data) - len(data.rstrip(b"\x00"))))
    if data[-128:-125] != b"xxx":
        return None
    return "x" * at + "TAG" + "x" * (n - at - 3)


TEXTS = [t for t in map(with_tag_at_128, range(64, 6400, 64)) if t]


def test_payload_with_tag_is_no_id3v1(spark):
    assert TEXTS
    for text in TEXTS:
        data = M.write_stream(text.encode())
        assert data[-128:-125] == b"TAG"
        s = M.read_stream(data)
        assert M.payload_of(s) == text.encode() and "id3v1" not in s.tags and s.skipped == 0
    docs = spark.createDataFrame(enumerate(TEXTS[:3]), "doc_id long, text string")
    assert M.round_trip(docs).count() == len(TEXTS[:3])
    assert sorted(r["n_bytes"] for r in M.round_trip(docs).collect()) == sorted(map(len, TEXTS[:3]))


@pytest.mark.parametrize("text", [b"x" * 64, TEXTS[0].encode()])
def test_real_tag_after_the_frames(text):
    data = M.write_stream(text) + b"TAG" + b"Title".ljust(125, b"\x00")
    s = M.read_stream(data)
    assert s.tags["id3v1"] == "Title" and M.payload_of(s) == text and s.skipped == 0
