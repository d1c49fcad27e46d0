import hashlib
import io
from collections import Counter

import pytest

from paperfold.llm import warc
from paperfold.llm.common import prepared
from paperfold.llm.queries import QUERIES, SQL

BIG = "<p>" + "x" * 1200


def frame(spark, rows):
    prepared(spark)
    return spark.createDataFrame([(*r, "d", 1) for r in rows], "page_id bigint, url string, html string, digest string, first bigint")


def test_round_trip(spark):
    rows = [(1, "http://a/ b", BIG), (2, None, BIG), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (None, "u", BIG), (7, "ü", "é" * 600), (2, None, BIG), (None, None, "é")]
    archives = warc.write(frame(spark, rows))
    got = warc.read(archives, payloads=True).collect()
    assert archives.groupBy().sum("records").first()[0] == len(rows) == len(got)
    want = Counter()
    for i, _, html in rows:
        data = (html or "").encode()
        again = html == BIG and i != 2
        want[i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", 2 if again else None, b"" if again else data] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)) for r in got) == want
    assert warc.read(warc.write(frame(spark, []))).count() == 0


def test_against_sql(spark, con, folder):
    got = QUERIES["op7_zstd_archives"](spark, str(folder))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({SQL['op7_zstd_archives']})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))


def archive(records, words=b"HTTP/1.1 200 OK"):
    folder = io.BytesIO()
    writer = warc.Writer("", words)
    writer.out = folder
    folder.write(warc.struct.pack("<II", warc.SKIPPABLE, len(words)) + words)
    for r in records:
        list(writer.add(r))
    return folder.getvalue()


def test_broken_archives():
    good = warc.record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None)
    data = archive([good, good])
    assert [warc.parsed(r)["payload"] for r in warc.records_of(io.BytesIO(data))] == [b"payload"] * 2
    with pytest.raises(warc.ArchiveError):
        list(warc.records_of(io.BytesIO(data[:-3])))
    with pytest.raises(warc.ArchiveError):
        list(warc.records_of(io.BytesIO(b"\0" * 50)))
    for bad in (good.replace(b"payload\r\n", b"paylord\r\n"), good[:-1], good.replace(b"WARC/1.1", b"WARC/0.9"), good.replace(b"WARC-Type: response\r\n", b""), good.replace(b"Content-Length: 7", b"Content-Length: 6")):
        with pytest.raises(warc.ArchiveError):
            warc.parsed(bad)


def test_many_archives(spark, monkeypatch):
    writer = warc.Writer(warc.shared_uri(prepared(spark), "warc-test"), b"words")
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 400)
    done = [x for k in range(20) for x in writer.add(warc.record(k, "u", bytes([k]) * 50, hashlib.sha1(bytes([k]) * 50).hexdigest(), None))]
    done.append(writer.closed())
    assert len(done) > 3 and sum(n for _, n in done) == 20
    got = warc.read(spark.createDataFrame(done, "archive string, records bigint"))
    assert sorted(r.page_id for r in got.collect()) == list(range(20))


def test_archives_are_read_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    archives = warc.write(frame(spark, [(k, None, f"{k}" * 700) for k in range(400)]))
    out = warc.read(archives)
    busy = out.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert archives.count() > 8 and sum(busy) == 400 and sum(x > 0 for x in busy) > 4
