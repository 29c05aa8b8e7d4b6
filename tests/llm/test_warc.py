import gzip
import hashlib
import io

import pytest

from lodestack.llm import warc as w


def pages(spark, *rows):
    rows = rows or [(0, None, None)]
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, payload string, record_type string")


def test_members_and_scanning():
    records = [w.record([("WARC-Type", t), ("WARC-Record-ID", f"<{i}>"), ("X", None)], bytes([65 + i]) * n) for i, (t, n) in enumerate([("response", 5000), ("revisit", 0), ("response", 0), ("request", 70000)])]
    own = b"".join(map(w.member, records))
    foreign = b"".join(map(gzip.compress, records))
    named = b"".join(b"\x1f\x8b\x08\x08" + bytes(6) + b"name\0" + gzip.compress(r)[10:] for r in records)
    assert gzip.decompress(own) == b"".join(records)
    for data in (own, foreign, named, b"".join(records), own + foreign + b"".join(records)):
        every = list(w.scan(io.BytesIO(data), lambda h: True, True))
        assert [p[:1] * len(p) for _, p in every] == [p for _, p in every]
        assert [len(p) for _, p in every][:4] == [5000, 0, 0, 70000]
        counts = {}
        some = list(w.scan(io.BytesIO(data), lambda h: h["warc-type"] == "request", True, counts))
        assert {len(p) for _, p in some} == {70000}
        heads = list(w.scan(io.BytesIO(data), lambda h: True, False))
        assert all(p is None for _, p in heads)
    counts = {}
    list(w.scan(io.BytesIO(own), lambda h: h["warc-type"] == "revisit", True, counts))
    assert counts == {"inflated": 1, "skipped": 3}
    for cut in (5, 40, len(own) - 3):
        if cut < len(own) - 3:
            with pytest.raises((ValueError, IndexError, Exception)):
                list(w.scan(io.BytesIO(own[:cut]), lambda h: True, True))
    with pytest.raises(ValueError, match="WARC"):
        list(w.scan(io.BytesIO(b"hello"), lambda h: True, True))


def test_round_trip(spark, tmp_path):
    big = "é" * 100
    long = "<p>" + "漢 lorem " * 40000
    rows = [(1, "http://a/\r\nx%y", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (7, "u", long), (8, "u", long), (None, "u", big), (2, None, big), (1, "again", big)]
    w.write_archive(pages(spark, *rows).repartition(3), str(tmp_path / "w"))
    got = w.read_archive(spark, str(tmp_path / "w")).collect()
    assert len(got) == len(rows)
    digest = lambda t: "sha256:" + hashlib.sha256((t or "").encode()).hexdigest()
    key = lambda i: None if i is None else f"<urn:page:{i}>"
    want = []
    for i, url, html in rows:
        first = {big: 1, long: 7}.get(html)
        revisit = first is not None and i is not None and i != first
        want.append((key(i), "revisit" if revisit else "response", url, key(first) if revisit else None, digest(html), len((html or "").encode()), None if revisit else (html or "").encode()))
    have = [(r["record_id"], r["record_type"], r["target_uri"], r["refers_to"], r["payload_digest"], r["payload_bytes"], None if r["record_type"] == "revisit" else bytes(r["payload"])) for r in got]
    assert sorted(map(str, have)) == sorted(map(str, want))
    responses = {r["record_id"]: r for r in got if r["record_type"] == "response" and r["record_id"]}
    for r in got:
        if r["record_type"] == "revisit":
            assert responses[r["refers_to"]]["payload_digest"] == r["payload_digest"]
    only = w.read_archive(spark, str(tmp_path / "w"), "revisit", payload=False).collect()
    assert {r["record_type"] for r in only} == {"revisit"}
    assert all(r["payload"] is None for r in only)
    one = w.read_archive(spark, str(tmp_path / "w"), WARC_Record_ID="<urn:page:3>").collect()
    assert [bytes(r["payload"]) for r in one] == [b"small"]


def test_pushed_predicates(spark, tmp_path):
    w.write_archive(pages(spark, (1, "u", "x" * 200), (2, "u", "x" * 200), (3, "u", "y")), str(tmp_path / "w"))
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = spark.read.format("warc").option("path", str(tmp_path / "w")).option("pushdown", "true").load()
        got = df.where("record_type = 'response' and payload_bytes > 100 and record_id in ('<urn:page:1>', '<urn:page:3>')")
        assert [r["record_id"] for r in got.collect()] == ["<urn:page:1>"]
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


def test_uncommitted_files_are_not_read(spark, tmp_path):
    w.write_archive(pages(spark, (1, "u", "x")), str(tmp_path / "w"))
    (tmp_path / f"w/part-{"f" * 32}.warc.gz").write_bytes(b"half a reco")
    assert w.read_archive(spark, str(tmp_path / "w")).count() == 1
    w.write_archive(pages(spark, (1, "u", "x")).where("false"), str(tmp_path / "none"))
    assert w.read_archive(spark, str(tmp_path / "none")).count() == 0


def test_appending_and_overwriting(spark, tmp_path):
    at = tmp_path / "w"
    ids = lambda: sorted(r["record_id"] for r in w.read_archive(spark, str(at)).collect())
    w.write_archive(pages(spark, (1, "u", "one"), (2, "u", "two")).repartition(2), str(at))
    w.write_archive(pages(spark, (3, "u", "three")), str(at))
    assert ids() == ["<urn:page:1>", "<urn:page:2>", "<urn:page:3>"]
    # A lost attempt's file, which no manifest names, and another writer's archives.
    lost = w.member(w.record([("WARC-Type", "response"), ("WARC-Record-ID", "<lost>")], b"x"))
    (at / f"part-{'0' * 32}.warc.gz").write_bytes(lost)
    foreign = [w.record([("WARC-Type", "response"), ("WARC-Record-ID", f"<foreign-{n}>")], b"y" * 300000) for n in range(3)]
    (at / "CRAWL-0001.warc.gz").write_bytes(b"".join(map(gzip.compress, foreign[:2])))
    (at / "plain.warc").write_bytes(foreign[2])
    assert ids() == ["<foreign-0>", "<foreign-1>", "<foreign-2>", "<urn:page:1>", "<urn:page:2>", "<urn:page:3>"]
    w.write_archive(pages(spark, (4, "u", "four")), str(at), mode="overwrite")
    assert ids() == ["<urn:page:4>"]
    w.write_archive(pages(spark).where("false"), str(at), mode="overwrite")
    assert ids() == []


def test_reads_are_buffered(tmp_path):
    records = b"".join(w.member(w.record([("WARC-Type", "revisit")], b"")) for _ in range(2000))

    class Counting(io.BytesIO):
        asked = 0

        def readinto(self, b):
            Counting.asked += 1
            return super().readinto(b)

    with io.BufferedReader(Counting(records), w.BUFFER) as f:
        assert len(list(w.scan(f, lambda h: True, True))) == 2000
    # The last records of a file ask once or twice more for what comes after the end.
    assert Counting.asked <= 40
