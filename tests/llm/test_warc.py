"""Operator 13 against a plain reading of its files."""

import base64
import gzip
import hashlib
import random
import re
from pathlib import Path

import pytest
from conftest import DATA

from eventlift.llm import warc
from eventlift.llm.oracle import ORACLES
from eventlift.llm.queries import QUERIES

SCHEMA = "page_id long, url string, html string, `a.b` int, digest string"


def pages_of(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(parts)


def expected(rows, min_bytes=0):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "", (r[2] or "")))
    first, out = {}, []
    for page, _, html in order:
        payload = (html or "").encode()
        again = len(payload) >= min_bytes and payload in first
        first.setdefault(payload, page)
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        kind = "revisit" if again else "response"
        out.append((page, len(payload), digest, kind, first[payload] if again else None))
    return sorted(out, key=repr)


def found(records):
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return sorted((tuple(r[c] for c in columns) for r in records), key=repr)


def odd_rows(seed):
    r = random.Random(seed)
    texts = ["", None, "<p>é\r\n\r\nWARC/1.1</p>", "x" * 3000, "\x00\n", *[f"page {i}" * 40 for i in range(12)]]
    urls = [None, "", "http://a/ b\r\nX: y", "http://ü.example/"]
    return [(r.choice([None, *range(30)]), r.choice(urls), r.choice(texts)) for _ in range(250)]


@pytest.mark.parametrize("min_bytes", [0, 100])
@pytest.mark.parametrize("shard_bytes", [15_000, 1 << 30])
def test_round_trip(spark, tmp_path, min_bytes, shard_bytes):
    rows = odd_rows(shard_bytes)
    root = str(tmp_path / "archive")
    warc.write_archive(pages_of(spark, rows), root, min_bytes=min_bytes, shard_bytes=shard_bytes, file_bytes=2000)
    back = warc.read_archive(spark, root).collect()
    assert found(back) == expected(rows, min_bytes)
    for r in back:
        assert (r["payload"] is None) == (r["record_type"] == "revisit")
        if r["payload"] is not None:
            assert base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode() == r["payload_digest"]
    ids = {r["record_id"]: r for r in back}
    assert len(ids) == len(rows)
    for r in ids.values():
        if r["record_type"] == "revisit":
            first = ids[r["refers_to_id"]]
            assert first["record_type"] == "response" and first["payload_digest"] == r["payload_digest"]


def test_files_roll_and_hold_members(spark, tmp_path):
    rows = [(i, f"http://h/{i}", random.Random(i).randbytes(600).hex()) for i in range(60)]
    root = str(tmp_path / "archive")
    manifest = warc.write_archive(pages_of(spark, rows), root, file_bytes=8000).collect()
    assert len(manifest) > 3 and all(f["bytes"] < 8000 + 1500 for f in manifest)
    assert sum(f["records"] for f in manifest) == 60
    ids = []
    for f in sorted(manifest):
        raw = Path(root, "data", f["file"]).read_bytes()
        assert hashlib.sha256(raw).hexdigest() == f["sha256"] and len(raw) == f["bytes"]
        text = gzip.decompress(raw)
        ids += [int(x) for x in re.findall(rb"\r\nX-Page-Id: (\d+)\r\n", text)]
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    assert ids == list(range(60))


def test_same_files_however_rows_were_partitioned(spark, tmp_path):
    rows = odd_rows(5)
    sums = []
    for parts in (1, 7):
        random.Random(parts).shuffle(rows)
        manifest = warc.write_archive(pages_of(spark, rows, parts), str(tmp_path / str(parts)), shard_bytes=20_000)
        sums.append(sorted(map(tuple, manifest.collect())))
    assert sums[0] == sums[1] and len(sums[0]) > 5


def test_copies_of_one_record_fill_many_shards(spark, tmp_path):
    rows = [(7, "u", "same" * 50)] * 400 + [(i, "v", "same" * 50) for i in range(20)]
    root = str(tmp_path / "archive")
    manifest = warc.write_archive(pages_of(spark, rows), root, shard_bytes=20_000).collect()
    assert max(f["records"] for f in manifest) < 60
    assert found(warc.read_archive(spark, root).collect()) == expected(rows)


def test_empty_table(spark, tmp_path):
    root = str(tmp_path / "archive")
    assert warc.write_archive(pages_of(spark, []), root).count() == 0
    assert warc.read_archive(spark, root).count() == 0
    with pytest.raises(FileExistsError):
        warc.write_archive(pages_of(spark, []), root)


def test_damage_is_an_error(spark, tmp_path):
    root = str(tmp_path / "archive")
    warc.write_archive(pages_of(spark, odd_rows(1)), root)
    file = next(Path(root, "data").iterdir())
    raw = bytearray(file.read_bytes())
    raw[len(raw) // 2] ^= 1
    file.write_bytes(raw)
    with pytest.raises(Exception, match="damaged|not the file|decompress|WARC|record|invalid"):
        warc.read_archive(spark, root).collect()


def test_files_outside_the_manifest_do_not_count(spark, tmp_path):
    root = str(tmp_path / "archive")
    rows = odd_rows(2)
    warc.write_archive(pages_of(spark, rows), root)
    Path(root, "data", "shard-99999-00000.warc.gz").write_bytes(b"left by a lost executor")
    assert found(warc.read_archive(spark, root).collect()) == expected(rows)


def test_twin(spark, duck):
    result = duck.execute(ORACLES["op13_warc"])
    names = [c[0] for c in result.description]
    df = QUERIES["op13_warc"](spark, f"{DATA}/sf0.01").select(*names)
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(result.fetchall(), key=repr)
