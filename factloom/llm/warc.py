"""WARC archives: a deterministic sharded writer, and the reader of what it wrote.

Records are put in the order of their page ids and dealt into shards of equal payload bytes by exact running sums, so the
same table gives the same files, whatever the partitions were. A record's headers and digests are made anew and its member
compressed before it is dealt out; of records with equal payloads the first is written whole, the others as revisits of it.

Archives are a Spark data source (``spark.read.format("warc")``, ``df.write.format("warc")``). A task writes under temporary names of its own
and rolls to a new file where the next member would take it beyond the size; the driver renames the files of the tasks
that count, then publishes a manifest in one rename. A folder without a manifest is no archive, so a task or driver that
dies leaves nothing that is read.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from factloom.llm.ranges import range_sorted
from factloom.llm.shared import new_path, stage, text_batches, unstage

#: A file is rolled before it has more compressed bytes; payloads from so many bytes on can be revisits.
ROLL_BYTES, LEAST_SHARED = 1 << 30, 100
DATE = "2024-01-01T00:00:00Z"
#: Bytes that a record has besides its payload, for even shards.
_REST_BYTES = 400
_CHUNK = 1 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD = "last long, id long, at long, page_id long, url string, payload_bytes long, payload_digest string, record_id string, member binary"
_ROWS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, record_id string, payload binary"
_KEY = ["last", "id", "at"]


def http_header(n: int) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n


def header_uri(url: str) -> str:
    """``url`` with all that isn't visible ASCII percent-encoded, so that it stays in its header line."""
    return re.sub(rb"[^\x21-\x7e]", lambda m: b"%%%02X" % m[0][0], url.encode("utf-8", "replace")).decode("ascii")


def member(kind: str, fields: list[tuple[str, str | int | None]], block: bytes, payload: bytes = b"") -> bytes:
    """One record as a gzip member of its own. Fields without a value are left out."""
    digest = hashlib.sha256(block)
    digest.update(payload)
    fields = [("WARC-Type", kind), *fields, ("WARC-Block-Digest", f"sha256:{digest.hexdigest()}"), ("Content-Length", len(block) + len(payload))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return b"".join([pack.compress(head.encode("ascii")), pack.compress(block), pack.compress(payload), pack.compress(b"\r\n\r\n"), pack.flush()])


def _fields(date: str, record_id: str, page_id: int | None, url: str | None, digest: str) -> list[tuple[str, str | int | None]]:
    uri = None if url is None else header_uri(url)
    return [("WARC-Record-ID", f"<urn:uuid:{record_id}>"), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Page-Id", page_id), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")]


def _records(batches: Iterator[pa.RecordBatch], date: str) -> Iterator[pa.RecordBatch]:
    """The last column, a payload, gives way to the record's member."""
    for batch in batches:
        members = []
        for page_id, url, size, digest, record_id, payload in zip(*(c.to_pylist() for c in batch.columns[3:])):
            members.append(member("response", _fields(date, record_id, page_id, url, digest), http_header(size), payload))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(members, pa.binary())], names=[f.split()[0] for f in _RECORD.split(", ")])


def file_system(path: str):
    """The file system of ``path`` and the path in it; a path without scheme is local."""
    from pyarrow import fs

    if re.match(r"[a-z][a-z0-9+.-]*:", path) and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)


@dataclass
class _Written(WriterCommitMessage):
    files: list[dict]


@dataclass
class _File(InputPartition):
    name: str
    bytes: int
    sha256: str


class WarcWriter(DataSourceArrowWriter):
    """Rows in order: shard, page_id, url, payload_bytes, payload_digest, record_id, member, refers_to, refers_id, refers_url. A row
    without member says what the next one is a revisit of."""

    def __init__(self, options: dict) -> None:
        self.out, self.date, self.roll = options["path"].rstrip("/"), options.get("date", DATE), int(options.get("roll_bytes", ROLL_BYTES))
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, out = file_system(self.out)
        mine = f"{out}/_temporary/{self.job}/{uuid.uuid4().hex}"
        fs.create_dir(mine, recursive=True)
        files, stream, shard, refers = [], None, None, None

        def close() -> None:
            if stream is not None:
                stream.close()
                files[-1]["sha256"] = files[-1]["sha256"].hexdigest()

        def put(raw: bytes) -> None:
            stream.write(raw)
            files[-1]["bytes"] += len(raw)
            files[-1]["sha256"].update(raw)

        for batch in iterator:
            for row in batch.to_pylist():
                if row["member"] is None:
                    refers = row
                    continue
                raw = row["member"]
                if refers is not None:
                    about = [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<urn:uuid:{refers['refers_id']}>"), ("WARC-Refers-To-Target-URI", None if refers["refers_url"] is None else header_uri(refers["refers_url"])), ("WARC-Refers-To-Page-Id", refers["refers_to"])]
                    raw = member("revisit", _fields(self.date, row["record_id"], row["page_id"], row["url"], row["payload_digest"]) + about, http_header(row["payload_bytes"]))
                    refers = None
                if row["shard"] != shard or files[-1]["bytes"] + len(raw) > self.roll:
                    close()
                    turn = 0 if row["shard"] != shard else turn + 1
                    shard = row["shard"]
                    name = f"pages-{shard:06d}-{turn:05d}.warc.gz"
                    files.append({"name": name, "records": 0, "bytes": 0, "sha256": hashlib.sha256(), "temporary": f"{mine}/{name}"})
                    stream = fs.open_output_stream(files[-1]["temporary"], compression=None)
                    put(member("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(name.encode()).digest()[:16])}>"), ("WARC-Date", self.date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                put(raw)
                files[-1]["records"] += 1
        close()
        return _Written(files)

    def commit(self, messages: list) -> None:
        fs, out = file_system(self.out)
        files = sorted((f for m in messages if m is not None for f in m.files), key=lambda f: f["name"])
        for f in files:
            _replace(fs, f.pop("temporary"), f"{out}/{f['name']}")
        fs.create_dir(out, recursive=True)
        with fs.open_output_stream(f"{out}/_manifest.{self.job}", compression=None) as stream:
            stream.write("".join(json.dumps(f, sort_keys=True) + "\n" for f in files).encode())
        _replace(fs, f"{out}/_manifest.{self.job}", f"{out}/manifest.jsonl")
        self._clear(fs, out)

    def abort(self, messages: list) -> None:
        self._clear(*file_system(self.out))

    def _clear(self, fs, out: str) -> None:
        from pyarrow.fs import FileType

        mine = f"{out}/_temporary/{self.job}"
        if fs.get_file_info(mine).type == FileType.Directory:
            fs.delete_dir(mine)


def _replace(fs, old: str, new: str) -> None:
    from pyarrow.fs import FileType, LocalFileSystem

    if not isinstance(fs, LocalFileSystem) and fs.get_file_info(new).type != FileType.NotFound:
        fs.delete_file(new)  # left by a writer that died before its manifest
    fs.move(old, new)


def _members(stream) -> Iterator[bytes]:
    """The members of a gzip stream one by one, each whole."""
    unpack, parts, raw = zlib.decompressobj(31), [], b""
    while raw or (raw := stream.read(_CHUNK)):
        parts.append(unpack.decompress(raw))
        raw = unpack.unused_data
        if unpack.eof:
            yield b"".join(parts)
            unpack, parts = zlib.decompressobj(31), []
    if parts:
        raise ValueError("archive ends within a record")


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record; its length and digest must fit."""
    head, _, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.decode("ascii").split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block, end = rest[: int(fields["Content-Length"])], rest[int(fields["Content-Length"]) :]
    if first != "WARC/1.1" or end != b"\r\n\r\n" or fields["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"record {fields.get('WARC-Record-ID')} is damaged")
    return fields, block


class WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.out, self.payloads = options["path"].rstrip("/"), options.get("payload", "true").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        fs, out = file_system(self.out)
        with fs.open_input_stream(f"{out}/manifest.jsonl", compression=None) as stream:
            files = [json.loads(line) for line in stream.read().decode().splitlines()]
        return [_File(f["name"], f["bytes"], f["sha256"]) for f in files] or [_File("", 0, "")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        fs, out = file_system(self.out)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("payload", pa.binary())])
        rows, held = [], 0
        with fs.open_input_stream(f"{out}/{partition.name}", compression=None) as raw:
            stream = _Checked(raw)
            for record in _members(stream):
                fields, block = parse(record)
                if fields["WARC-Type"] == "warcinfo":
                    continue
                head, _, payload = block.partition(b"\r\n\r\n")
                n, digest = int(head.rsplit(b"Content-Length: ", 1)[1]), fields["WARC-Payload-Digest"].removeprefix("sha256:")
                whole = fields["WARC-Type"] == "response"
                if whole and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
                page, refers = fields.get("WARC-Page-Id"), fields.get("WARC-Refers-To-Page-Id")
                rows.append((None if page is None else int(page), fields.get("WARC-Target-URI"), fields["WARC-Type"], n, digest, None if refers is None else int(refers), fields["WARC-Record-ID"][10:-1], payload if whole and self.payloads else None))
                held += len(payload) if self.payloads else 100
                if held > 4 * _CHUNK:
                    yield _batch(rows, schema)
                    rows, held = [], 0
        if stream.size != partition.bytes or stream.digest.hexdigest() != partition.sha256:
            raise ValueError(f"{partition.name} isn't the file of the manifest")
        if rows:
            yield _batch(rows, schema)


class _Checked:
    """A stream that counts and digests what is read from it."""

    def __init__(self, raw) -> None:
        self.raw, self.size, self.digest = raw, 0, hashlib.sha256()

    def read(self, n: int) -> bytes:
        got = self.raw.read(n)
        self.size += len(got)
        self.digest.update(got)
        return got


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


class WarcSource(DataSource):
    """Options: path; roll_bytes and date to write; payload=false to leave the payloads out when reading."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return _ROWS

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def write_archives(pages: DataFrame, out: str, shards: int | None = None, roll_bytes: int = ROLL_BYTES, least_shared: int = LEAST_SHARED, date: str = DATE) -> None:
    """Write a record for every row of ``pages`` (page_id, url, html and any others) under ``out``, a new folder in a store that all workers reach.

    Records are in the order of page_id, null last, in ``shards`` shards (by default as many as shuffles have partitions)
    and files of ``roll_bytes`` at most, unless one record has more. Of rows with equal payloads of ``least_shared`` bytes or more the
    first is a response and the others revisit it; equal page_ids follow each other in the order that their rows are read in, repeated rows
    have a record each. A null html is an empty payload, a null page_id or url leaves its header out. An
    empty table gives an archive without files.
    """
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    text_batches(spark)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    page_id = F.col("page_id").cast("long")
    keyed = pages.select(page_id.isNull().cast("long").alias("last"), F.coalesce(page_id, F.lit(0)).alias("id"), F.monotonically_increasing_id().alias("at"), page_id.alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    hashed = keyed.select(*_KEY, "page_id", "url", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "payload")
    hexed = F.sha2(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")), "payload_digest", "at"), 256)
    record_id = F.concat_ws("-", *[F.substring(hexed, i, n) for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    raw = stage(hashed.select(*_KEY, "page_id", "url", "payload_bytes", "payload_digest", record_id.alias("record_id"), "payload"), "warc-records")
    slim = raw.drop("payload")
    shared = slim.filter(F.col("payload_bytes") >= least_shared)
    first = shared.groupBy("payload_digest").agg(F.min(F.struct(*_KEY, "page_id", "url", "record_id")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    again = shared.join(first, "payload_digest").filter(F.col("at") != F.col("first.at"))
    revisits = stage(again.select(*_KEY, F.col("first.page_id").alias("refers_to"), F.col("first.record_id").alias("refers_id"), F.col("first.url").alias("refers_url")), "warc-revisits")
    sizes = slim.select(*_KEY, "payload_bytes").unionByName(revisits.select(*_KEY, F.lit(None).cast("long").alias("payload_bytes")))
    sizes = sizes.groupBy(*_KEY).agg((_REST_BYTES + F.when(F.count("*") > F.count("payload_bytes"), 0).otherwise(F.max("payload_bytes"))).alias("size"))
    bounds = _bounds(range_sorted(sizes, _KEY, shards, "warc-order"), shards)
    records = raw.mapInArrow(partial(_records, date=date), _RECORD)

    @F.pandas_udf("int")
    def shard(last: pd.Series, key: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(bounds, k) for k in zip(last, key, at)], dtype="int32")

    # a revisit's row comes right before the record that it is about
    rows = revisits.unionByName(records, allowMissingColumns=True).withColumn("shard", shard(*_KEY))
    dealt = rows.repartition(shards, "shard").sortWithinPartitions("shard", *_KEY, F.col("member").isNotNull())
    dealt.select("shard", "page_id", "url", "payload_bytes", "payload_digest", "record_id", "member", "refers_to", "refers_id", "refers_url").write.format("warc").option("path", out).option("roll_bytes", str(roll_bytes)).option("date", date).mode("append").save()
    unstage(revisits)
    unstage(raw)


def _bounds(ordered: DataFrame, shards: int) -> list[tuple[int, int, int]]:
    """First key of each shard but the first; shards have equal sums of sizes. One row for each range and shard goes to the driver."""
    from pyspark.sql import Window

    before, offsets = 0, []
    for r in ordered.groupBy("_part").agg(F.sum("size").alias("n")).orderBy("_part").collect():
        offsets.append((r["_part"], before))
        before += r.n
    if not before:
        return []
    offsets = ordered.sparkSession.createDataFrame(offsets, "_part int, _before long")
    within = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    running = ordered.withColumn("_sum", F.coalesce(F.sum("size").over(within), F.lit(0))).join(F.broadcast(offsets), "_part")
    of = F.floor((F.col("_before") + F.col("_sum")).cast("decimal(38,0)") * shards / F.lit(before)).cast("int")
    return sorted(tuple(r.key) for r in running.groupBy(of.alias("shard")).agg(F.min(F.struct(*_KEY)).alias("key")).collect())[1:]


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest (lower-case hex), refers_to (page_id), record_id and payload (null for revisits)
    of every record under ``path``. Lengths and digests of files, blocks and payloads are checked; damage is an error."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).load()


def archived(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and return their records; see :func:`write_archives`."""
    out = new_path(pages.sparkSession, "warc")
    write_archives(pages, out, **options)
    return read_archives(pages.sparkSession, out, payload=False)
