"""WARC archives of pages: a deterministic sharded writer and a checking reader.

Records are sorted by page id, url and payload and cut into shards of equal weight. The borders
come from running totals of bytes over the sorted records, not from a sample, so the same rows give
the same files, byte for byte, however they were partitioned. A task writes one shard, a gzip
member for each record, and begins another file when the compressed bytes reach ``file_bytes``.

Files are written under temporary names and renamed when whole. What a task has renamed is listed
in a manifest (name, size, checksum), a Parquet table that Spark commits when all tasks are done;
readers know no other files. A task that runs twice renames equal bytes onto the same name.

Only the sorted keys are grouped and joined; payloads are shuffled once, to their shard. Records
that refer to another's payload are written from their keys. Copies of one record (same id, url and
payload) that fill more than a shard are counted before the shuffle and dealt out by number.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlift.llm.tasks import Batches, arrow_map, batch_of, ship
from eventlift.sources.workspace import Workspace

#: Raw bytes of a shard at least, and how many shards there are at most; beyond that they grow.
SHARD_BYTES, MAX_SHARDS = 8 << 20, 16_384
FILE_BYTES = 256 << 20
#: Bytes that a record counts besides its payload when shards are cut.
RECORD_BYTES = 512
READ_BYTES, BATCH_BYTES = 1 << 20, 4 << 20
#: How hard members are compressed; beyond it files shrink by 3 % for a quarter more time.
LEVEL = 3
#: Crawl dates are not among the columns; a fixed one keeps the archive the same on every run.
DATE = "1970-01-01T00:00:00Z"
# Fixed values of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_URI = "about:blank"

ORDER = ["no_id", "id", "no_url", "url", "digest"]
_ROW = "no_id boolean, id long, no_url boolean, url string, digest string, shard int, kind int"
_ROW += ", bytes long, sha1 string, copies long, home boolean, leads boolean, first_id long, first_url string"
_ROW += ", payload binary"
_MANIFEST = "file string, shard int, records long, bytes long, sha256 string, first_id long, last_id long"
_RECORD = "record_id string, record_type string, page_id long, url string, payload_bytes long"
_RECORD += ", payload_digest string, refers_to long, refers_to_id string, payload binary, file string"
_RECORD_SCHEMA = pa.schema(
    [(n, pa.int64() if k == "long" else pa.binary() if k == "binary" else pa.string())
     for n, k in (c.split() for c in _RECORD.split(", "))]
)
_MANIFEST_SCHEMA = pa.schema(
    [("file", pa.string()), ("shard", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()),
     ("sha256", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64())]
)


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; the same on the driver and in tasks."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/+", "/", path)
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record_id(page: int | None, url: str | None, digest: str, copy: str = "") -> str:
    """Names the record by what it holds; copies of it also by their place."""
    name = f"{page}\t{'' if url is None else '=' + url}\t{digest}\t{copy}"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def member(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """One record as a gzip member; its length and block digest are worked out here."""
    digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
    headers = [*headers, ("WARC-Block-Digest", f"sha1:{digest}"), ("Content-Length", len(block))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    raw = b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"
    return packer.compress(raw) + packer.flush()


def _uri(url: str | None) -> str:
    """As a header value: control characters and spaces percent-encoded."""
    return re.sub("[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url or "") or NO_URI


def page_record(row: dict, copy: int, revisit: bool, payload: bytes | None, date: str) -> bytes:
    """The record of one page; ``row`` holds its keys, ``payload`` is for responses."""
    again = "" if copy == 0 and row["home"] else f"{row['shard']}.{copy}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['bytes']}\r\n\r\n"
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(row["id"], row["url"], row["digest"], again)),
        ("WARC-Date", date),
        ("WARC-Target-URI", _uri(row["url"])),
        ("WARC-Payload-Digest", f"sha1:{base32(row['sha1'])}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("X-Page-Id", row["id"]),
    ]
    if revisit:
        headers += [
            ("WARC-Profile", REVISIT_PROFILE),
            ("WARC-Refers-To", record_id(row["first_id"], row["first_url"], row["digest"])),
            ("WARC-Refers-To-Target-URI", _uri(row["first_url"])),
            ("WARC-Refers-To-Date", date),
            ("X-Refers-To-Page-Id", row["first_id"]),
        ]
    return member(headers, http.encode() + (b"" if revisit else payload))


class _Files:
    """The files of one shard: temporary until whole, another one beyond ``limit`` bytes."""

    def __init__(self, root: str, shard: int, limit: int, date: str):
        self.system, self.root = store(root)
        self.shard, self.limit, self.date = shard, limit, date
        self.number, self.sink = 0, None

    def add(self, page: int | None, packed: bytes) -> Iterator[tuple]:
        if self.sink is None:
            self.name = f"shard-{self.shard:05d}-{self.number:05d}.warc.gz"
            self.temporary = f"{self.root}/_temporary/{self.name}.{uuid.uuid4().hex}"
            self.system.create_dir(f"{self.root}/_temporary", recursive=True)
            self.sink, self.hash = self.system.open_output_stream(self.temporary, compression=None), hashlib.sha256()
            self.bytes, self.records, self.first = 0, 0, page
            about = [
                ("WARC-Type", "warcinfo"),
                ("WARC-Record-ID", record_id(None, self.name, "warcinfo")),
                ("WARC-Date", self.date),
                ("WARC-Filename", self.name),
                ("Content-Type", "application/warc-fields"),
            ]
            self._write(member(about, b"format: WARC File Format 1.1\r\n"))
        self._write(packed)
        self.records, self.last = self.records + 1, page
        if self.bytes >= self.limit:
            yield self.close()

    def _write(self, packed: bytes) -> None:
        self.sink.write(packed)
        self.hash.update(packed)
        self.bytes += len(packed)

    def close(self) -> tuple:
        """Rename the file and return its line of the manifest."""
        self.sink.close()
        self.system.create_dir(f"{self.root}/data", recursive=True)
        self.system.move(self.temporary, f"{self.root}/data/{self.name}")
        self.sink, self.number = None, self.number + 1
        digest = self.hash.hexdigest()
        return self.name, self.shard, self.records, self.bytes, digest, self.first, self.last

    def rest(self) -> Iterator[tuple]:
        if self.sink is not None:
            yield self.close()


def _written(root: str, least: int, limit: int, date: str):
    """A task that writes sorted rows (a record's keys, then its payload) as files."""

    def lines(batches: Batches) -> Iterator[tuple]:
        files, keys = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if files is None or files.shard != row["shard"]:
                    if files is not None:
                        yield from files.rest()
                    files = _Files(root, row["shard"], limit, date)
                if row["kind"] == 0:
                    if keys is not None:
                        raise ValueError(f"no payload came for page {keys['id']}")
                    keys, payload = row, None
                    shared = row["bytes"] >= least
                    first = not shared or (row["leads"] and row["home"])
                    if first:
                        continue  # its payload is the next row
                elif keys is None:
                    continue  # the payload of a revisit, or of a further copy
                else:
                    payload = row["payload"]
                    if hashlib.sha1(payload).hexdigest() != keys["sha1"]:
                        raise ValueError(f"the payload of page {keys['id']} has another digest")
                for copy in range(keys["copies"]):
                    revisit = shared and not (first and copy == 0)
                    yield from files.add(keys["id"], page_record(keys, copy, revisit, payload, date))
                keys = None
        if keys is not None:
            raise ValueError(f"no payload came for page {keys['id']}")
        if files is not None:
            yield from files.rest()

    def write(batches: Batches) -> Batches:
        for line in lines(batches):
            yield batch_of(_MANIFEST_SCHEMA, [[v] for v in line])

    return write


def _shards_of(cuts: list[tuple]):
    """First and last shard of a key, given the least key of each shard.

    A key that begins a shard belongs to it; one that begins several is dealt out among them.
    """

    @F.arrow_udf("first int, last int")
    def found(no_id: pa.Array, id: pa.Array, no_url: pa.Array, url: pa.Array, digest: pa.Array) -> pa.Array:
        first, last = [], []
        for a, b, c, d, e in zip(*(x.to_pylist() for x in (no_id, id, no_url, url, digest))):
            key = (a, b or 0, c, d or "", e)
            low, high = bisect_left(cuts, key), bisect_right(cuts, key) - 1
            first.append(low if low <= high else high)
            last.append(high)
        return pa.StructArray.from_arrays([pa.array(first, pa.int32()), pa.array(last, pa.int32())], ["first", "last"])

    return found


def _records(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    rows = pages.select(
        pages[id_col].cast("long").alias("id"),
        pages[url_col].cast("string").alias("url"),
        F.coalesce(pages[payload_col].cast("binary"), F.lit(b"")).alias("payload"),
    )
    return rows.select(
        F.isnull("id").alias("no_id"),
        "id",
        F.isnull("url").alias("no_url"),
        "url",
        F.sha2("payload", 256).alias("digest"),
        "payload",
    )


def _cuts(keys: DataFrame, shard_bytes: int, max_shards: int, workspace: Workspace) -> list[tuple]:
    """The least key of every shard, by the running total of bytes over all sorted keys.

    The keys are ranged and summed in parts, a number for each part reaches the driver; the total
    before a key is the same however they were ranged.
    """
    weight = F.col("copies") * (F.col("bytes") + F.lit(RECORD_BYTES))
    ranged = keys.select(*ORDER, weight.alias("weight")).repartitionByRange(*ORDER)
    ranged = workspace.stage(ranged.withColumn("part", F.spark_partition_id()), "warc-order")
    parts = sorted(ranged.groupBy("part").agg(F.sum("weight").alias("w")).collect())
    total = sum(p["w"] for p in parts)
    if not total:
        return []
    size = max(shard_bytes, -(-total // max_shards))
    before, starts = 0, []
    for p in parts:
        starts.append((p["part"], before))
        before += p["w"]
    starts = keys.sparkSession.createDataFrame(starts, "part int, before long")
    so_far = f"sum(weight) OVER (PARTITION BY part ORDER BY {', '.join(ORDER)} ROWS UNBOUNDED PRECEDING)"
    placed = ranged.selectExpr("*", f"{so_far} AS upto").join(starts, "part")
    shards = "explode(sequence((before + upto - weight) DIV {0}, (before + upto - 1) DIV {0})) AS shard"
    least = (
        placed.selectExpr(f"struct({', '.join(ORDER)}) AS key", shards.format(size))
        .groupBy("shard")
        .agg(F.min("key").alias("key"))
    )
    return [
        (k["no_id"], k["id"] or 0, k["no_url"], k["url"] or "", k["digest"])
        for _, k in sorted(least.collect(), key=lambda r: r["shard"])
    ]


def write_archive(
    pages: DataFrame,
    root: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_bytes: int = 0,
    shard_bytes: int = SHARD_BYTES,
    max_shards: int = MAX_SHARDS,
    file_bytes: int = FILE_BYTES,
    date: str = DATE,
    workspace: Workspace | None = None,
) -> DataFrame:
    """Write a WARC record for each row under ``root``; returns the manifest.

    ``root`` must be a folder that all executors share and that has no manifest yet. Of records with
    equal payloads of at least ``min_bytes`` bytes the one of least id is a ``response``, the others
    are ``revisit`` records that refer to it; smaller payloads are written each time. Rows without
    an id come last. Ties of an id go by url (nulls last), then payload; of rows equal in all three
    one is the first. A null payload is empty, a null or empty url becomes ``about:blank``. Control
    characters and spaces of a url are percent-encoded. Other columns, whatever their names, are
    left out. An empty table gives an empty manifest.
    """
    spark = ship(pages.sparkSession)
    system, folder = store(root)
    if system.get_file_info(f"{folder}/manifest/_SUCCESS").type != fs.FileType.NotFound:
        raise FileExistsError(f"{root} already holds an archive")
    workspace = workspace or Workspace(spark)
    rows = _records(pages, id_col, url_col, payload_col)
    facts = rows.select(*ORDER, F.octet_length("payload").cast("long").alias("bytes"), F.sha1("payload").alias("sha1"))
    keys = workspace.stage(facts.groupBy(*ORDER, "bytes", "sha1").agg(F.count("*").alias("copies")), "warc-keys")
    cuts = _cuts(keys, shard_bytes, max_shards, workspace)
    shards_of = _shards_of(cuts)(*ORDER)

    first = keys.groupBy("digest").agg(F.min(F.struct(*ORDER[:4])).alias("lead"))
    share = "copies DIV (last - first + 1) + if(shard - first < copies % (last - first + 1), 1, 0)"
    heads = (
        keys.withColumn("at", shards_of)
        .select("*", "at.*")
        .join(first, "digest")
        .withColumn("shard", F.explode(F.sequence("first", "last")))
        .selectExpr(
            *ORDER, "shard", "0 AS kind", "bytes", "sha1", f"{share} AS copies", "shard = first AS home",
            f"struct({', '.join(ORDER[:4])}) = lead AS leads", "lead.id AS first_id", "lead.url AS first_url",
            "CAST(NULL AS BINARY) AS payload",
        )
        .where("copies > 0")
    )
    placed = rows.withColumn("at", shards_of).select(*ORDER, "payload", "at.*")
    bodies = placed.where("first = last").withColumnRenamed("first", "shard")
    several = any(a == b for a, b in zip(cuts, cuts[1:]))
    if several:  # records whose copies fill more than a shard: one payload for each shard
        many = placed.where("first < last").groupBy(*ORDER, "first", "last").agg(F.first("payload").alias("payload"))
        many = many.withColumn("shard", F.explode(F.sequence("first", "last")))
        bodies = bodies.select(*ORDER, "shard", "payload").unionAll(many.select(*ORDER, "shard", "payload"))
    bodies = bodies.selectExpr(
        *ORDER, "shard", "1 AS kind", "CAST(NULL AS BIGINT) AS bytes", "CAST(NULL AS STRING) AS sha1",
        "CAST(NULL AS BIGINT) AS copies", "CAST(NULL AS BOOLEAN) AS home", "CAST(NULL AS BOOLEAN) AS leads",
        "CAST(NULL AS BIGINT) AS first_id", "CAST(NULL AS STRING) AS first_url", "payload",
    )
    dealt = heads.unionAll(bodies).repartitionById(max(1, len(cuts)), F.col("shard"))
    dealt = dealt.sortWithinPartitions("shard", *ORDER, "kind")
    manifest = arrow_map(dealt, _written(root, min_bytes, file_bytes, date), _MANIFEST)
    manifest.write.parquet(f"{root}/manifest")
    return read_manifest(spark, root)


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """The files of a committed archive."""
    return spark.read.schema(_MANIFEST).parquet(f"{root}/manifest")


def _headers(raw: bytes) -> dict[str, str]:
    first, *lines = raw.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    return dict(line.split(": ", 1) for line in lines)


class _Stream:
    """The decompressed bytes of a file, read in pieces and summed up on the way."""

    def __init__(self, source: pa.NativeFile):
        self.source, self.hash, self.bytes = source, hashlib.sha256(), 0
        self.held, self.at, self.unpacker, self.left = bytearray(), 0, zlib.decompressobj(31), b""

    def more(self) -> bool:
        """Hold some more bytes; False at the end of the file."""
        del self.held[: self.at]
        self.at = 0
        if not self.left:
            self.left = self.source.read(READ_BYTES)
            if not self.left:
                return False
            self.hash.update(self.left)
            self.bytes += len(self.left)
        self.held += self.unpacker.decompress(self.left, READ_BYTES)
        if self.unpacker.eof:
            self.left, self.unpacker = self.unpacker.unused_data, zlib.decompressobj(31)
        else:
            self.left = self.unpacker.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes | None:
        seen = self.at
        while (end := self.held.find(mark, seen)) < 0:
            searched = len(self.held) - self.at
            if not self.more():
                if self.held:
                    raise ValueError("the file ends inside a record")
                return None
            seen = max(0, searched - len(mark))
        piece = bytes(self.held[self.at : end])
        self.at = end + len(mark)
        return piece

    def take(self, size: int) -> bytes:
        while len(self.held) - self.at < size:
            if not self.more():
                raise ValueError("the file ends inside a record")
        piece = bytes(self.held[self.at : self.at + size])
        self.at += size
        return piece


def records_of(source: pa.NativeFile) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record; yields the stream's checksum and size at the end."""
    stream = _Stream(source)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        headers = _headers(head)
        block = stream.take(int(headers["Content-Length"]))
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError("a record has another length than its header says")
        if headers["WARC-Block-Digest"] != f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}":
            raise ValueError(f"block of {headers['WARC-Record-ID']} is damaged")
        yield headers, block
    yield {"sha256": stream.hash.hexdigest(), "bytes": stream.bytes}, b""


def _page(headers: dict[str, str], block: bytes, payloads: bool, file: str) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(re.search(rb"(?m)^Content-Length: (\d+)", http)[1])
    response = headers["WARC-Type"] == "response"
    if response and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"payload of {headers['WARC-Record-ID']} is damaged")
    page, refers = headers.get("X-Page-Id"), headers.get("X-Refers-To-Page-Id")
    return (
        headers["WARC-Record-ID"], headers["WARC-Type"], page and int(page), headers["WARC-Target-URI"], size,
        digest, refers and int(refers), headers.get("WARC-Refers-To"), payload if response and payloads else None,
        file,
    )


def _read(root: str, payloads: bool):
    def read(batches: Batches) -> Batches:
        system, folder = store(root)
        for batch in batches:
            for line in batch.to_pylist():
                held, size, records = [], 0, 0
                with system.open_input_stream(f"{folder}/data/{line['file']}", compression=None) as source:
                    for headers, block in records_of(source):
                        kind = headers.get("WARC-Type")
                        if kind is None and (headers["sha256"], headers["bytes"]) != (line["sha256"], line["bytes"]):
                            raise ValueError(f"{line['file']} is not the file of the manifest")
                        if kind not in ("response", "revisit"):
                            continue
                        held.append(_page(headers, block, payloads, line["file"]))
                        records, size = records + 1, size + 500 + (len(block) if payloads else 0)
                        if size >= BATCH_BYTES:
                            yield batch_of(_RECORD_SCHEMA, list(zip(*held)))
                            held, size = [], 0
                if records != line["records"]:
                    raise ValueError(f"{line['file']} lacks records")
                if held:
                    yield batch_of(_RECORD_SCHEMA, list(zip(*held)))

    return read


def read_archive(spark: SparkSession, root: str, payloads: bool = True) -> DataFrame:
    """The records of the files that the manifest lists, a task for each file.

    Sizes, counts and digests of files, blocks and payloads are checked; damage is an error. A
    revisit has no payload of its own, ``payload_bytes`` and ``payload_digest`` are those of the
    payload it refers to.
    """
    manifest = read_manifest(spark, root)
    files = max(1, manifest.count())
    return arrow_map(manifest.repartition(files), _read(root, payloads), _RECORD)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write all pages as an archive in the shared folder and read it back."""
    workspace = Workspace(pages.sparkSession)
    root = workspace.new_path("warc")
    write_archive(pages, root, min_bytes=min_bytes, workspace=workspace)
    back = read_archive(pages.sparkSession, root, payloads=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
