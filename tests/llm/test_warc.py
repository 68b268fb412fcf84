import hashlib
import io

import zstandard

from histscore.llm import warc as W


def test_bundle_is_seekable_and_plain_zstd():
    sink = io.BytesIO()
    w = W.BundleWriter(sink)
    records = {}
    for k in range(50):
        raw = W.record_bytes(f"urn:x:{k}", k, None, bytes([k]) * (k * 2000), hashlib.sha1(b"").hexdigest(), None)
        w.add(f"urn:x:{k}", raw)
        records[f"urn:x:{k}"] = raw
    w.close()
    reader = W.BundleReader(sink, sink.tell())
    assert len(reader.frames) > 1
    assert dict(reader.records()) == records
    assert reader.record("urn:x:37") == records["urn:x:37"]
    sink.seek(0)
    whole = zstandard.ZstdDecompressor().stream_reader(sink, read_across_frames=True).read()
    assert whole == b"".join(records.values())


def brute(rows):
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == raw]
        ids = [p for p in same if p is not None]
        top = max(ids) if ids else None
        revisit = len(raw) >= 1000 and len(same) > 1 and top is not None and page != top
        out.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


def test_odd_pages(spark):
    big = "é<p>\r\n\r\n" * 300
    rows = [
        (1, "u", big), (5, None, big), (5, "u\r\nX: y", big), (3, "u", big), (None, "u", big), (7, "u", None), (8, "u", ""),
        (9, "u", "x" * 999), (10, "u", "x" * 999), (11, "u", "x" * 1000), (12, "u", "x" * 1000), (13, "u", "z" * 3_000_000),
        (None, "u", "q" * 2000), (None, "u", "q" * 2000),
    ]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, g_page int, payload_digest string").repartition(4)
    got = W.read_bundles(W.write_bundles(W.decide_records(df.select("page_id", "url", "html"))))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)
    with_clash = W.read_bundles(W.write_bundles(W.decide_records(df)))
    assert with_clash.count() == len(rows)
    assert W.read_bundles(W.write_bundles(W.decide_records(df.limit(0)))).count() == 0


def test_small_bundles(spark, monkeypatch):
    df = spark.createDataFrame([(k, f"u{k}", f"{k}" * 5000) for k in range(60)], "page_id long, url string, html string")
    monkeypatch.setattr(W, "BUNDLE", 500)
    monkeypatch.setattr(W, "FRAME", 3000)
    manifest = W.write_bundles(W.decide_records(df))
    assert manifest.count() > 1
    assert W.read_bundles(manifest).count() == 60
