import io
import os
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from paperfold.llm import records
from paperfold.llm.common import store
from paperfold.llm.queries import QUERIES
from paperfold.llm.tokens import default_path
from tests.llm.helpers import ODD, table, texts


def encoded(rows):
    """(doc_id, start, ids) in ascending order, null ids first."""
    tokenizer, out, start = Tokenizer.from_file(default_path()), [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, start, ids))
        start += len(ids)
    return out


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_whole_table(spark, folder):
    out = QUERIES["op11_binary_records"](spark, str(folder))
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    want = [(i, start, len(ids), crc(ids)) for i, start, ids in encoded(texts(folder))]
    assert sorted(map(tuple, out.collect())) == sorted(want)


def test_odd_rows_round_trip(spark, monkeypatch):
    monkeypatch.setattr(records, "FILE_BYTES", 200)
    manifest = records.write(table(spark, ODD))
    files = manifest.orderBy("number").collect()
    assert [f.number for f in files] == list(range(len(files))) and len(files) > 1
    out = sorted(records.read(manifest, ids=True).collect(), key=lambda r: r.position)
    assert [r.position for r in out] == list(range(len(ODD)))
    assert [(r.doc_id, r.start, r.ids, r.n_tokens, r.ids_crc32) for r in out] == [(i, s, ids, len(ids), crc(ids)) for i, s, ids in encoded(ODD)]
    assert records.read(records.write(table(spark, []))).count() == 0


def test_rows_of_one_id_and_text(spark):
    rows = [(7, f"text {k % 3}") for k in range(60)] + [(None, None)] * 5
    out = sorted(records.read(records.write(table(spark, rows)), ids=True).collect(), key=lambda r: r.start)
    assert [r.start for r in out] == [sum(x.n_tokens for x in out[:k]) for k in range(65)]
    assert sorted(r.ids_crc32 for r in out) == sorted(crc(ids) for _, _, ids in encoded(rows)) and [r.doc_id for r in out] == [None] * 5 + [7] * 60


def test_reads_in_any_order(spark, folder, monkeypatch):
    monkeypatch.setattr(records, "FILE_BYTES", 20_000)
    monkeypatch.setattr(records, "_OPEN", 2)
    manifest = records.write(table(spark, texts(folder)))
    whole = {r.position: r for r in records.read(manifest, ids=True).collect()}
    one, two = (records.shuffled(manifest, seed).collect() for seed in (1, 2))
    assert {r.position: r for r in one} == whole and len(one) == len(whole)
    orders = [[r.position for r in x] for x in (one, two)]
    assert orders[0] != orders[1] and orders[0] != sorted(orders[0]) and sorted(orders[1]) == sorted(whole)
    wanted = spark.createDataFrame([(3,), (3,), (len(whole) - 1,), (len(whole),), (-1,), (None,), (0,)], "position int")
    got = records.pick(manifest, wanted).collect()
    assert sorted(r.position for r in got) == [0, 3, 3, len(whole) - 1] and all(r == whole[r.position] for r in got)


def test_a_task_for_each_file(spark, folder, monkeypatch):
    monkeypatch.setattr(records, "FILE_BYTES", 20_000)
    manifest = records.write(table(spark, texts(folder)))
    assert records.read(manifest).rdd.getNumPartitions() == manifest.count() > 10


def test_wide_ids():
    ids = np.array([1, 70_000, 2], np.uint32)
    for name in (None, -5, 2**62):
        back, found = records.unpacked(records.packed(name, ids, True))
        assert back == name and found.tolist() == ids.tolist()


def test_any_damage_is_found(spark):
    payloads = [records.packed(k, np.arange(k, dtype=np.uint32), False) for k in range(4)]
    good = b"".join(map(records.framed, payloads))
    stream = io.BytesIO(good)
    assert [records.next_payload(stream) for _ in range(5)] == [*payloads, None]
    for k in range(len(good)):
        stream = io.BytesIO(good[:k] + bytes([good[k] ^ 1]) + good[k + 1 :])
        with pytest.raises(records.RecordError):
            while records.next_payload(stream) is not None:
                pass
    manifest = records.write(table(spark, ODD[:5]))
    f = manifest.first()
    path = store(f.file)[1]
    entries = open(path + ".idx", "rb").read()
    for broken in (entries[:-1], entries + b"x", b"\1" + entries[1:]):
        with open(path + ".idx", "wb") as out:
            out.write(broken)
        with pytest.raises(records.RecordError):
            list(records._records(f.file, f.records, f.tokens))
    with open(path + ".idx", "wb") as out:
        out.write(entries)
    os.truncate(path + ".rec", os.path.getsize(path + ".rec") - 30)
    with pytest.raises(records.RecordError):
        list(records._records(f.file, f.records, f.tokens))
