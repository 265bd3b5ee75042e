import gzip
import hashlib
import os
import random

import pytest

from claimloom.llm.warc import inflated, normalise, normalise_file, parsed, read_records, record, record_id, records, revisits, round_trip, write_archives


def raw(i, payload, kind="response"):
    return record(kind, record_id(i, 0), f"http://x/{i}", payload, hashlib.sha256(payload).hexdigest(), record_id(3, 0) if kind == "revisit" else None, "2024-01-01T00:00:00Z")


def test_members_and_offsets(tmp_path):
    r = random.Random(1)
    payloads = [b"", b"\r\n\r\n", b"WARC/1.1\r\nContent-Length: 5\r\n\r\n", r.randbytes(700_000)] + [r.randbytes(r.randint(0, 3000)) for _ in range(50)]
    own = [raw(i, p) for i, p in enumerate(payloads)] + [raw(99, b"abc", "revisit")]
    whole = tmp_path / "a.warc.gz"
    for data in (gzip.compress(b"".join(own)), gzip.compress(b"".join(own[:9])) + gzip.compress(b"".join(own[9:])), b"".join(map(gzip.compress, own))):
        whole.write_bytes(data)
        rows = list(normalise_file(str(whole), str(tmp_path / "b.warc.gz")))
        out = (tmp_path / "b.warc.gz").read_bytes()
        assert [gzip.decompress(out[at : at + n]) for _, at, n, _ in rows] == own
        assert gzip.decompress(out) == b"".join(own) and rows[-1][3]["warc-type"] == "revisit"
    assert [parsed(x)[2] for x in own[:-1]] == payloads and parsed(own[-1])[2] == b""
    with pytest.raises(ValueError):
        list(records(iter([own[0][:-9]])))
    whole.write_bytes(gzip.compress(b""))
    assert list(records(inflated(open(whole, "rb")))) == []


def test_pages(spark, tmp_path):
    big, bigger = "é" * 60, "x" * 3_000_000
    rows = [(5, "u", big, 1), (2, None, big, 1), (9, "u\r\nv", big, 1), (1, "u", "short", 1), (3, "u", "short", 1), (4, "u", None, 1), (None, "u", big, 1), (7, "u", bigger, 1), (8, "u", bigger, 1), (8, "u", bigger, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    got = round_trip(df, str(tmp_path)).collect()
    want = []
    for i, _, h, _ in rows:
        b = (h or "").encode()
        first = min(j for j, _, k, _ in rows if k == h and j is not None) if len(b) >= 100 else i
        to = first if i is not None and first < i else None
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if to is not None else "response", to))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert round_trip(df.limit(0), str(tmp_path)).count() == 0


def test_sidecar_names_each_member(spark, tmp_path):
    (tmp_path / "w.warc.gz").write_bytes(gzip.compress(b"".join(raw(i, b"p%d" % i) for i in range(20))))
    index = normalise(spark.createDataFrame([(str(tmp_path / "w.warc.gz"),)], "path string"), str(tmp_path / "out")).cache()
    rows = index.collect()
    lines = [x.split("\t") for x in open(rows[0].sidecar).read().splitlines()]
    assert [(int(x[0]), int(x[1]), x[2], x[3]) for x in lines] == [(r.offset, r.length, r.record_type, r.record_id) for r in rows]
    assert sum(r.length for r in rows) == os.path.getsize(rows[0].archive)
    assert sorted(bytes(r.payload) for r in read_records(index).collect()) == sorted(b"p%d" % i for i in range(20))


def test_record_ids_are_unique_and_revisits_point_at_one(spark, tmp_path):
    big = "é" * 60
    rows = [(2, "u", big), (2, "u", big), (None, "u", big), (None, "u", "x"), (5, "u", big), (7, "u", big)]
    own = write_archives(revisits(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)), str(tmp_path / "a"))
    got = normalise(own, str(tmp_path / "b")).collect()
    ids = [x.record_id for x in got]
    assert len(set(ids)) == len(rows) and sorted(x.record_type for x in got) == ["response"] * 4 + ["revisit"] * 2
    assert len({x.refers_to for x in got if x.refers_to}) == 1 and all(x.refers_to in ids for x in got if x.refers_to)
    assert {x.record_type for x in got if ":page:2:" in x.record_id or ":page::" in x.record_id} == {"response"}


def test_index_rows_come_in_batches(spark, tmp_path):
    (tmp_path / "w.warc.gz").write_bytes(gzip.compress(b"".join(raw(i, b"p") for i in range(9000))))
    index = normalise(spark.createDataFrame([(str(tmp_path / "w.warc.gz"),)], "path string"), str(tmp_path / "out"))
    assert [x.record_no for x in index.orderBy("offset").collect()] == list(range(9000))
