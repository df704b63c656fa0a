"""Deterministic sharded WARC writer and its reader.

Records are range-sorted by page id with boundaries that depend on the rows only, written one gzip member each, and rolled to
a new file by compressed size. A file is written under a temporary name and then renamed; the manifest, a table, is written
when all files stand, and readers trust nothing else. Headers and digests are made anew from the payload, and no time of day
or random id enters: the same rows give the same bytes, so a task that is run again after a lost executor replaces its files
by equal ones.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ravelin.llm import histsort, memory
from ravelin.llm.store import filesystem, shared_dir, written

#: Payloads of fewer bytes are never revisits; payload bytes of a sorted range; compressed bytes after which a file is rolled.
LEAST_REVISIT, RANGE_BYTES, ROLL_BYTES = 1000, 32 << 20, 16 << 20
#: Fixed values of the format.
_VERSION, _PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: int, url: str | None, date: str, payload: bytes | None, kind: str, refers_to: int | None, sha1: str, length: int, copy: int = 0) -> bytes:
    """One record: an HTTP response with its payload, or a revisit with the headers only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    block = http + (payload or b"") if kind == "response" else http
    head = [
        _VERSION,
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{_name(page_id, kind, sha1, copy)}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_header(url)}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        f"X-Page-ID: {page_id}",
        f"X-Payload-Length: {length}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:uuid:{_name(refers_to, 'response', sha1, 0)}>", f"X-Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _name(page_id: int, kind: str, sha1: str, copy: int) -> uuid.UUID:
    """A record's id: of its page, kind and payload, and its number among records that are alike in these."""
    return uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{kind}:{sha1}:{copy}")


def _header(value: str | None) -> str:
    """A header's value stays on its line: white space becomes %20."""
    return "%20".join((value or "").split())


def gzipped(data: bytes) -> bytes:
    """A gzip member without a time stamp."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    return b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff" + body + zlib.crc32(data).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")


def verdicts(pages: DataFrame, id_col: str, text_col: str, least: int = LEAST_REVISIT) -> tuple[DataFrame, DataFrame]:
    """(digests, responses): (page_id, payload_bytes, sha1) of every row, and (sha1, refers_to) of payloads that occur more than once."""
    html = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digests = written(pages.select(F.col(id_col).cast("long").alias("page_id"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(F.encode(html, "UTF-8")).alias("sha1")), "digests")
    # maxima combine before the shuffle, so a payload of a third of all rows is one row of each task
    many = digests.where((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull()).groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
    return digests, written(many.where("n > 1").select("sha1", "refers_to"), "responses")


_MANIFEST = pa.schema([("part", pa.int32()), ("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])


def _writer(folder: str, date: str, roll: int):
    """Rows (part, page_id, url, html, sha1, refers_to) sorted by part, page and payload: of each first the verdict (html null), if
    it is a revisit, then its rows in the order of their addresses."""

    def rows(batches):
        from pyspark import TaskContext

        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        tag = f".{TaskContext.get().taskAttemptId()}.tmp"
        now: dict = {"part": None, "file": None}

        def closed():
            now["out"].close()
            fs.move(posixpath.join(root, now["file"] + tag), posixpath.join(root, now["file"]))
            row = {"part": now["part"], "file": now["file"], "records": now["records"], "bytes": now["bytes"], "sha256": now["sha"].hexdigest()}
            now["file"] = None
            return pa.RecordBatch.from_pylist([row], _MANIFEST)

        known, refers, copy = (None, None), None, -1
        for batch in batches:
            for part, page, url, html, sha1, verdict in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if known != (page, sha1):
                    known, refers, copy = (page, sha1), None, -1
                if html is None:
                    refers = verdict
                    continue
                copy += 1
                if now["file"] and (now["part"] != part or now["bytes"] >= roll):
                    yield closed()
                if now["part"] != part:
                    now |= {"part": part, "seq": 0}
                if not now["file"]:
                    now |= {"file": f"pages-{part:06d}-{now['seq']:05d}.warc.gz", "records": 0, "bytes": 0, "sha": hashlib.sha256(), "seq": now["seq"] + 1}
                    now["out"] = fs.open_output_stream(posixpath.join(root, now["file"] + tag), compression=None)
                payload = (html or "").encode()
                digest = hashlib.sha1(payload).hexdigest()
                if digest != sha1:
                    raise ValueError(f"page {page}: the payload isn't the one that was judged")
                kind = "response" if refers is None else "revisit"
                data = gzipped(record(page, url, date, payload, kind, refers, digest, len(payload), copy))
                now["out"].write(data)
                now["sha"].update(data)
                now["records"] += 1
                now["bytes"] += len(data)
        if now["file"]:
            yield closed()

    return rows


def _parted(cuts: histsort.Ranges):
    def rows(batches):
        for batch in batches:
            part = cuts.of(batch.column(0).to_numpy(), batch.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *batch.columns[:5]], ["part", *batch.schema.names[:5]])

    return rows


def write_warc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", date: str = "2024-01-01T00:00:00Z", range_bytes: int = RANGE_BYTES, roll_bytes: int = ROLL_BYTES) -> tuple[str, DataFrame]:
    """(folder, manifest): every row of ``pages`` as a record; ``date`` is the capture time that the table doesn't hold.

    Of records with equal payloads of 1000 bytes or more, the one with the largest page id is the response and the others are
    revisits of it. A null payload is empty, a null address is an empty header. Rows that repeat an id and a payload are each a
    record with an id of its own; those with the largest page id are all responses. Rows without an id are left out, as they have no place in the order.
    An empty table gives no files. Columns besides the three are never read.
    """
    spark = pages.sparkSession
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(text_col).cast("string").alias("html")).where("page_id is not null")
    digests, responses = verdicts(pages, "page_id", "html")
    # ties are cut by a part of the digest, so a page id on many rows doesn't meet in one range
    tie = lambda sha1: F.conv(F.substring(sha1, 1, 15), 16, 10).cast("long")
    cuts = histsort.key_ranges(digests.select("page_id", tie("sha1").alias("tie"), (F.col("payload_bytes") + 300).alias("w")), "page_id", "tie", "w", range_bytes)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha1", F.sha1(F.encode("html", "UTF-8")))
    # the verdict on a payload of a page goes before its rows, so texts are shuffled once and never joined
    again = digests.select("page_id", "sha1").join(responses, "sha1").where("page_id < refers_to").select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "sha1", "refers_to").distinct()
    rows = rows.withColumn("refers_to", F.lit(None).cast("long")).union(again).withColumn("tie", tie("sha1"))
    placed = rows.mapInArrow(memory.lean(_parted(cuts)), "part int, page_id long, url string, html string, sha1 string, refers_to long")
    dealt = placed.repartitionById(len(cuts), "part").sortWithinPartitions("part", "page_id", "sha1", F.col("html").isNotNull(), F.coalesce("url", F.lit("")))
    folder = shared_dir(spark)
    manifest = dealt.mapInArrow(memory.lean(_writer(folder, date, roll_bytes)), "part int, file string, records long, bytes long, sha256 string")
    manifest.write.parquet(posixpath.join(folder, "_manifest"))
    return folder, spark.read.schema(manifest.schema).parquet(posixpath.join(folder, "_manifest"))


def records(stream):
    """(headers, block) of each record of a stream of gzip members; raises ValueError on a record that is cut off or damaged."""
    packer, buffer, end = zlib.decompressobj(31), b"", False
    while True:
        at = buffer.find(b"\r\n\r\n")
        if at >= 0:
            lines = buffer[:at].decode().split("\r\n")
            headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
            size = int(headers["Content-Length"])
            if lines[0] != _VERSION:
                raise ValueError(f"not a record: {lines[0]!r}")
            if len(buffer) >= at + 4 + size + 4:
                block = buffer[at + 4 : at + 4 + size]
                if headers["WARC-Block-Digest"] != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode():
                    raise ValueError("a record's block doesn't match its digest")
                buffer = buffer[at + 4 + size + 4 :]
                yield headers, block
                continue
        if end:
            if buffer:
                raise ValueError("the last record is cut off")
            return
        raw = packer.unused_data if packer.eof else b""
        if packer.eof:
            packer = zlib.decompressobj(31)
        raw = raw or stream.read(1 << 18)
        if raw:
            buffer += packer.decompress(raw)
        else:
            end = True


def _reader(folder: str):
    def rows(batches):
        fs, root = filesystem(folder)
        for batch in batches:
            for name, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out, seen = [], 0
                with fs.open_input_stream(posixpath.join(root, name), compression=None) as f:
                    for h, block in records(f):
                        seen += 1
                        digest = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        kind, payload = h["WARC-Type"], block.split(b"\r\n\r\n", 1)[1]
                        if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"{name}: a payload doesn't match its digest")
                        refers = h.get("X-Refers-To-Page-ID")
                        out.append((int(h["X-Page-ID"]), int(h["X-Payload-Length"]), digest, kind, int(refers) if refers else None, h["WARC-Target-URI"], payload.decode() if kind == "response" else None))
                        if len(out) == 500:
                            yield _batch(out)
                            out = []
                if seen != count:
                    raise ValueError(f"{name} has {seen} records; its manifest says {count}")
                yield _batch(out)

    return rows


_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("html", pa.string())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_READ)], schema=_READ)


def _one_by_one(files: DataFrame) -> DataFrame:
    """The files of a manifest, one in each task, or a few where there are very many."""
    tasks = max(1, min(files.count(), histsort.MOST_RANGES))
    numbered = files.withColumn("n", (F.row_number().over(Window.orderBy("file")) - 1) % tasks)
    return numbered.repartitionById(tasks, F.col("n").cast("int")).drop("n")


def read_warc(folder: str, manifest: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, html) of every record of the manifest's files; a revisit's html is null."""
    files = manifest.select("file", "records")
    return _one_by_one(files).mapInArrow(memory.lean(_reader(folder)), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, html string")
