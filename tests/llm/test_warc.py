import gzip
import hashlib
import base64
import random
import zlib

import pytest

from mnemoframe.llm import warc


def brute(rows, min_bytes=0):
    low = -(1 << 63)
    first = {}
    for p, _, h in rows:
        b = (h or "").encode()
        if len(b) >= min_bytes:
            first[b] = min(first.get(b, (p is not None, p or 0)), (p is not None, p or 0))
    out, taken = [], set()
    for p, _, h in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (h or "").encode()
        again = len(b) >= min_bytes and b in taken
        taken.add(b)
        origin = first.get(b, (True, None))
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", (origin[1] if origin[0] else None) if again else None))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=repr)


@pytest.mark.parametrize("least", [0, 5])
def test_against_brute_force(spark, monkeypatch, least):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 5000)
    rng = random.Random(1)
    texts = ["", "é", "same", "a\r\n\r\nb", "WARC/1.1\r\n\r\n", "x" * 40, "longer than five"]
    rows = [(i, f"http://h/{i}", rng.choice(texts) if rng.random() < 0.7 else f"own {i}") for i in range(200)]
    rows += [(300, None, None), (301, "bad\r\nurl", "same"), (7, "http://twice", "same"), (None, "http://null", "only null"), (400, "u", "only null"), (500, "u", "z" * 3_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as archive", "2 as nth", "3 as digest")
    assert rows_of(warc.archive_pages(df.repartition(5), min_bytes=least)) == brute(rows, least)
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_members_and_index(spark, monkeypatch):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    captured = warc.capture(pages)
    path = captured.first().archive.removeprefix("file://")
    raw = open(path, "rb").read()
    stream = zlib.decompressobj(31)
    whole = stream.decompress(raw)
    assert stream.eof and not stream.unused_data, "a capture is one gzip stream"
    done = warc.normalise(captured)
    found = warc.read_archives(done).collect()
    html = {r.page_id: r.html.encode() for r in pages.collect()}
    assert {r.page_id: bytes(r.payload) for r in found if r.record_type == "response"}.items() <= html.items() and len(found) == len(html)
    one = max(found, key=lambda r: r.offset)
    head, _, payload = warc.read_record(one.archive, one.offset, one.length)
    assert head["x-page-id"] == str(one.page_id) and payload == html[one.page_id]
    assert gzip.decompress(open(one.archive.removeprefix("file://"), "rb").read()).count(b"WARC-Type: response") >= 1


def test_damage_is_noticed(tmp_path):
    raw = warc.record(1, "u", b"abc", warc.digest_of(b"abc"), 3)
    with pytest.raises(ValueError):
        list(warc.Records(iter([raw[:-6]])))
    with pytest.raises(ValueError):
        list(warc.Records(iter([raw, b"WARC/1.1\r\nX"])))
    assert [b for _, b in warc.Records(iter([raw[i : i + 1] for i in range(len(raw))]))][0].endswith(b"abc")
