"""Round trips of the archive at every split, stored members inside payloads, and the defined cases."""

import gzip
import hashlib
import zlib

import pytest

from bookheat.llm import warc
from bookheat.llm.common import table
from bookheat.llm.warc_queries import SQL, op8_warc_round_trip
from tests.compare import connect, rows_of

SF = "/root/testdata/sf0.01"


def test_query(spark):
    df = op8_warc_round_trip(spark, SF)
    rel = connect(SF).execute(SQL)
    names = [d[0] for d in rel.description]
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, rel.fetchall())


@pytest.mark.parametrize("split", [64, 1000, 1 << 20])
def test_splits(spark, split):
    pages = table(spark, "/root/testdata/sf0.001", "pages")
    want = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    got = warc.read(warc.archive(pages), split).collect()
    assert len(got) == len(want)
    bodies = {hashlib.sha1(r.payload).hexdigest(): r.payload for r in got if r.record_type == "response"}
    for r in got:
        assert r.intact and r.payload_digest == hashlib.sha1(want[r.id]).hexdigest() and r.payload_bytes == len(want[r.id])
        assert bodies[r.payload_digest] == want[r.id]


def test_member_inside_a_payload(spark, tmp_path):
    inner = warc.record(9, "http://inner", b"inner" * 50, None, False)
    outer = zlib.compressobj(0, zlib.DEFLATED, 31)
    raw = gzip.decompress(warc.record(1, "http://outer", b"x" * 3000 + inner + b"y" * 3000, None, False))
    data = outer.compress(raw) + outer.flush() + warc.record(2, "a\r\nWARC-Type: revisit", b"", None, False)
    path = tmp_path / "a.warc.gz"
    path.write_bytes(data)
    manifest = spark.createDataFrame([(str(path), len(data))], "path string, bytes long")
    for split in (50, 3100, 1 << 20):
        assert sorted(r.id for r in warc.read(manifest, split).collect()) == [1, 2]


def test_cases(spark):
    long, text = "é" * 600, "y" * 999
    rows = [(1, "u", long, "a"), (3, "u", long, "b"), (3, "u", long, "b"), (None, None, long, None), (5, "u", text, "a"), (6, "u", text, "a"), (7, None, None, None), (8, "", "", ""), (None, "n", "z" * 1000, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    got = sorted(((r.id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read(warc.archive(pages)).collect()), key=str)
    want = [(1, "revisit", 3, 1200), (3, "response", None, 1200), (3, "response", None, 1200), (None, "revisit", 3, 1200), (5, "response", None, 999), (6, "response", None, 999), (7, "response", None, 0), (8, "response", None, 0), (None, "response", None, 1000)]
    assert got == sorted(want, key=str)
    assert warc.read(warc.archive(pages.limit(0))).count() == 0
