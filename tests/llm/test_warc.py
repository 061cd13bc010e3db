import io
import struct

import zstandard

from auditlake.llm import warc_archive as W
from auditlake.llm.common import new_path


def brute(rows):
    best = {}
    for page, _, html, *_ in rows:
        h = html or ""
        best[h] = max([x for x in (best.get(h), page) if x is not None], default=None)
    out = []
    for page, _, html, *_ in rows:
        data = (html or "").encode()
        top = best[html or ""]
        out.append((page, len(data), W.payload_digest(data), "response" if page == top else "revisit", None if page == top else top))
    return sorted(out, key=str)


def round_trip(spark, df):
    folder = new_path(spark, "warc-test")
    manifest = W.write_archives(W.plan_revisits(df), folder)
    return folder, manifest, W.read_archives(manifest, folder)


def test_edge_rows(spark):
    rows = [(1, "u", "a", 1), (2, None, "a", 1), (3, "x y", "", 1), (4, "v", None, 1), (None, "w", "a", 1), (5, "é", "é" * 100_000, 1), (6, "q", "\r\n\r\nWARC/1.1", 1), (7, "r", "only", 1), (7, "r", "only", 1)]
    rows += [(100 + i, "hot", "hot page", 1) for i in range(200)]
    folder, manifest, back = round_trip(spark, spark.createDataFrame(rows, "page_id long, url string, html string, payload int"))
    got = back.collect()
    assert sorted([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got], key=str) == brute(rows)
    assert all(r["block"].decode() == "é" * 100_000 for r in got if r["page_id"] == 5)
    path = manifest.first()["archive"]
    data = open(path, "rb").read()
    magic, n = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D
    known = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + n])))
    assert known.decompressobj().decompress(data[8 + n :]).startswith(b"WARC/1.1")  # the first record, on its own


def test_writer_trains_and_cuts(monkeypatch):
    monkeypatch.setattr(W, "SAMPLE_BYTES", 20_000)
    out = io.BytesIO()
    out.close = lambda: None
    writer = W.ArchiveWriter(out)
    records = [W.build_record(i, f"http://h/{i}", f"<html><body>page {i} {'common words ' * (i % 40)}</body></html>".encode(), None, False) for i in range(500)]
    for r in records:
        writer.add(r)
    writer.close()
    assert list(W.read_archive(io.BytesIO(out.getvalue()))) == records
    plain = sum(len(zstandard.compress(r)) for r in records)
    assert len(out.getvalue()) < plain


def test_empty_table_and_whole_query(spark, sf_dir):
    _, _, back = round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string"))
    assert back.count() == 0
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted([tuple(r) for r in W.op5(spark, sf_dir).collect()], key=str) == brute(rows)
