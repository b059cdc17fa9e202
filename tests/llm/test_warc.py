import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from nightjar.llm import warc


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(2)
    bodies = [f"<p>{k} é {'x' * rng.randrange(50)}</p>" for k in range(12)]
    bodies += ["", None, "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n", "\r\n\r\n", "y" * 300_000, "HTTP/1.1 200 OK\r\n\r\n"]
    return [(k, f"http://h/{k}", rng.choice(bodies)) for k in range(90)]


def brute(pages, least=0):
    out = {}
    for k, _, html in sorted(pages):
        body = (html or "").encode()
        first = min(j for j, _, h in pages if (h or "").encode() == body)
        revisit = len(body) >= least and first != k
        out[k] = (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", first if revisit else None)
    return out


@pytest.mark.parametrize("least,compression", [(0, "gzip"), (10, "none")])
def test_round_trip(spark, pages, tmp_path, least, compression):
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    path = str(tmp_path / f"a{least}")
    warc.write_archive(df, path, min_bytes=least, compression=compression)
    rows = warc.resolve(warc.read_archive(spark, path)).collect()
    got = {r["source_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows}
    assert len(rows) == len(pages) and got == brute(pages, least) and all(r["intact"] for r in rows)


def test_records_are_well_formed(spark, pages, tmp_path):
    warc.write_archive(spark.createDataFrame(pages[:20], "page_id long, url string, html string"), str(tmp_path / "b"), compression="none")
    ids = set()
    for f in (tmp_path / "b").glob("part-*"):
        for headers, block in warc.records_of(f.read_bytes()):
            ids.add(headers["warc-record-id"])
            assert headers["warc-type"] in ("response", "revisit") and len(block) == int(headers["content-length"])
            assert ("warc-refers-to" in headers) == (headers["warc-type"] == "revisit")
    assert len(ids) == 20


def test_odd_rows(spark, tmp_path):
    rows = [(None, None, "a"), (3, "http://h/\r\nX: y z", "a"), (3, "u", "a"), (2, None, None)]
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "c"))
    got = warc.resolve(warc.read_archive(spark, str(tmp_path / "c"))).collect()
    assert sorted((r["source_id"] or -1, r["record_type"]) for r in got) == [(-1, "revisit"), (2, "response"), (3, "response"), (3, "revisit")]
    assert {r["target_uri"] for r in got} == {"about:blank", "http://h/%0D%0AX:%20y%20z", "u"}


def test_empty(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "d"))
    assert warc.resolve(warc.read_archive(spark, str(tmp_path / "d"))).count() == 0


def test_every_record_is_a_member_and_files_are_bounded(spark, pages, tmp_path, monkeypatch):
    import zlib

    monkeypatch.setattr(warc, "FILE_BYTES", 100_000)
    big = [(100 + k, None, chr(97 + k) * 60_000) for k in range(12)] + [(200, "http://h/huge", "h" * 20_000_000)]
    df = spark.createDataFrame(pages + big, "page_id long, url string, html string")
    for name in ("e", "f"):
        warc.write_archive(df, str(tmp_path / name))
    files = sorted((tmp_path / "e").glob("part-*"))
    assert len(files) > 5
    n, ids = 0, set()
    for f in files:
        data = f.read_bytes()
        while data:  # a reader can start at each member
            member = zlib.decompressobj(31)
            text = member.decompress(data)
            if text:
                (record,) = warc.records_of(text)
                ids.add(record[0]["warc-record-id"])
                n += 1
            data = member.unused_data
    assert n == len(ids) == len(pages) + 13
    other = warc.read_archive(spark, str(tmp_path / "f")).collect()
    assert len(other) == n and not ids & {r["record_id"] for r in other}
    got = {r["source_id"]: r for r in warc.resolve(warc.read_archive(spark, str(tmp_path / "e"))).collect()}
    assert got[200]["payload_bytes"] == 20_000_000 and all(r["intact"] for r in got.values())


def test_files_of_one_member_and_broken_files():
    import gzip

    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    many = record * 40_000  # more than a piece
    for data in (many, gzip.compress(many), gzip.compress(record) * 3):
        found = list(warc.records_of(data))
        assert len(found) in (40_000, 3) and all(b == b"hello" for _, b in found)
    for data in (record[:-12], gzip.compress(record)[:-10], b"nonsense", record + b"WARC/1.1\r\nno end"):
        with pytest.raises(ValueError):
            list(warc.records_of(data))
    assert list(warc.records_of(b"")) == []


def record(kind="response", block=b"HTTP/1.1 200 OK\r\n\r\nhello", end=b"\r\n\r\n", version=b"WARC/1.0", **headers):
    lines = {"WARC-Type": kind, "Content-Type": "application/http; msgtype=response", "Content-Length": len(block)} | {k.replace("_", "-"): v for k, v in headers.items()}
    return version + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items() if v is not None).encode() + b"\r\n" + block + end


def test_archives_of_other_writers(spark, tmp_path):
    """warcinfo, request, metadata and resource records, missing headers, other digests, revisits by URI and date."""
    import gzip

    sha = base64.b32encode(hashlib.sha1(b"hello").digest()).decode()
    records = [
        record("warcinfo", b"software: x", Content_Type="application/warc-fields"),
        record("request", b"GET / HTTP/1.1\r\n\r\n", Content_Type="application/http; msgtype=request"),
        record(WARC_Record_ID="<a>", WARC_Target_URI="http://h/1", WARC_Date="2020-01-01T00:00:00Z", WARC_Payload_Digest=f"sha1:{sha}"),
        record(WARC_Record_ID="<b>", WARC_Target_URI="http://h/2", WARC_Date="2020-01-01T00:00:00Z"),  # no digest
        record(WARC_Record_ID="<c>", block=b"no header end", WARC_Payload_Digest="sha1:AAAA", WARC_Source_ID="x9"),
        record("resource", b"hello", WARC_Record_ID="<d>", Content_Type="text/plain", WARC_Payload_Digest="sha256:" + hashlib.sha256(b"hello").hexdigest(), end=b"\r\n\r\n\r\n\r\n"),
        record("revisit", b"", WARC_Record_ID="<r1>", WARC_Refers_To_Target_URI="http://h/1", WARC_Refers_To_Date="2020-01-01T00:00:00Z", WARC_Payload_Digest=f"sha1:{sha}", end=b""),
        record("revisit", b"", WARC_Record_ID="<r2>", WARC_Refers_To="<b>", version=b"WARC/0.18"),
        record("revisit", b"", WARC_Record_ID="<r3>", WARC_Refers_To="<gone>"),
        record("revisit", b"", WARC_Record_ID="<r4>"),
        record("metadata", "é".encode("latin-1"), Content_Type=None),
    ]
    for k, data in enumerate((b"".join(records), b"".join(map(gzip.compress, records)))):
        (tmp_path / str(k)).mkdir()
        (tmp_path / str(k) / "a.warc").write_bytes(data)
        read = warc.read_archive(spark, str(tmp_path / str(k)))
        assert [r["record_type"] for r in read.collect()] == ["warcinfo", "request", "response", "response", "response", "resource", "revisit", "revisit", "revisit", "revisit", "metadata"]
        got = {r["record_id"]: (r["payload_bytes"], r["intact"], r["refers_to_record"]) for r in warc.resolve(read).collect() if r["record_id"]}
        assert got == {"<a>": (5, True, None), "<b>": (5, None, None), "<c>": (0, False, None), "<d>": (5, True, None), "<r1>": (5, True, "<a>"), "<r2>": (5, None, "<b>"), "<r3>": (None, None, "<gone>"), "<r4>": (None, None, None)}


def test_damaged_files_give_what_can_be_read(spark, tmp_path):
    import gzip

    good = record(WARC_Record_ID="<a>")
    damaged = [
        good + b"garbage here", good + good[:-20], good + record(WARC_Record_ID="<b>", Content_Length="-3"), good + record(WARC_Record_ID="<b>", Content_Length="9" * 30),
        good + record(WARC_Record_ID="<b>", Content_Length=None), gzip.compress(good) + gzip.compress(good)[:-15], gzip.compress(good) + b"\x1f\x8bnonsense, no deflate stream",
    ]
    for k, data in enumerate(damaged):
        (tmp_path / f"{k}.warc").write_bytes(data)
    (tmp_path / "empty.warc").write_bytes(b"")
    rows = warc.read_archive(spark, str(tmp_path)).collect()
    assert sorted(r["record_type"] for r in rows) == ["broken"] * len(damaged) + ["response"] * len(damaged)
    assert all(r["intact"] is False for r in rows if r["record_type"] == "broken")


def test_few_partitions_roll_files(spark, pages, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 30_000)
    monkeypatch.setattr(warc, "TASKS", 2)
    big = [(100 + k, None, chr(97 + k) * 20_000) for k in range(20)]
    df = spark.createDataFrame(big, "page_id long, url string, html string")
    warc.write_archive(df, str(tmp_path / "g"))
    assert len(list((tmp_path / "g").glob("part-*"))) >= 15
    assert warc.read_archive(spark, str(tmp_path / "g")).where("intact").count() == 20
