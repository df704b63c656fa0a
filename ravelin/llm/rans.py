"""Token files coded with static range asymmetric numeral systems (rANS).

One frequency table over all documents is shared by all files. A file holds blocks of BLOCK ids that are coded on their own,
each by LANES interleaved states that share one stream of 32-bit words. Every block has checkpoints (the states and the place
in the stream, every STEPS steps) from which it can be decoded in parallel, and checksums of its words and of its ids.

File, all numbers little-endian: magic ``RANSTOK1``; blocks; then a zlib-compressed index (the documents' ids and token
counts, the blocks' places, checkpoints and checksums); then the index's place, length and crc32 and the table's crc32.
"""

from __future__ import annotations

import posixpath
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ravelin.llm import histsort, memory
from ravelin.llm.store import filesystem, shared_dir, written
from ravelin.llm.tokens import encoder

#: Bits of the frequency table; lanes of a block; steps between checkpoints; ids of a block.
SCALE, LANES, STEPS = 18, 32, 256
BLOCK = LANES * STEPS * 4
#: Text bytes of a file's range of documents, and ids that a task codes at once.
FILE_BYTES, GROUP = 16 << 20, 32 * BLOCK
#: Ids after which a task begins another file of its range (ranges of large inputs are larger than a file), and tasks that read at most.
ROLL_IDS, MOST_READERS = 8 << 20, 4096
MAGIC = b"RANSTOK1"
_LOW = np.uint64(1 << 31)


@dataclass
class Table:
    """Frequencies scaled to a sum of 2**SCALE; each id that occurs has one slot at least."""

    freq: np.ndarray
    start: np.ndarray
    symbol: np.ndarray
    crc: int

    @classmethod
    def of(cls, counts: np.ndarray) -> Table:
        size, total = 1 << SCALE, int(counts.sum())
        if not total:
            counts, total = np.array([1]), 1
        if np.count_nonzero(counts) > size:
            raise ValueError(f"{np.count_nonzero(counts)} ids don't fit in a table of {size} slots")
        freq = np.where(counts > 0, np.maximum(1, np.floor(counts / total * size)), 0).astype(np.int64)
        # the slots that rounding left over, or took too many, go to or come from the most frequent ids
        order = np.argsort(-freq, kind="stable")
        over = int(freq.sum()) - size
        while over > 0:
            rich = order[freq[order] > 1][: max(1, over)]
            freq[rich[:over]] -= 1
            over = int(freq.sum()) - size
        freq[order[0]] -= over
        return cls(freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64), np.repeat(np.arange(len(freq), dtype=np.uint32), freq), zlib.crc32(freq.astype("<u4").tobytes()))


def encode(blocks: np.ndarray, table: Table) -> list[tuple[bytes, np.ndarray, np.ndarray]]:
    """(words, states, places) of each row of ``blocks`` (rows of one length, a multiple of LANES): states and places of its checkpoints.

    Coding runs from the last id to the first, so that decoding runs forwards.
    """
    n, width = blocks.shape
    steps = width // LANES
    ids = blocks.reshape(n, steps, LANES)
    x = np.full((n, LANES), _LOW)
    words, out = np.zeros((steps, n, LANES), np.uint32), np.zeros((steps, n, LANES), bool)
    marks = []
    for t in range(steps - 1, -1, -1):
        f, c = table.freq[ids[:, t]], table.start[ids[:, t]]
        full = x >= (f << np.uint64(63 - SCALE))
        words[t], out[t] = x.astype(np.uint32), full
        x = np.where(full, x >> np.uint64(32), x)
        q = x // f
        x = (q << np.uint64(SCALE)) + (x - q * f) + c
        if t % STEPS == 0:
            marks.append(x.copy())
    marks = np.stack(marks[::-1], axis=1)  # block, checkpoint, lane
    per_step = out.sum(axis=2)
    places = np.concatenate((np.zeros((1, n), np.int64), np.cumsum(per_step, axis=0)))[:steps:STEPS]
    return [(words[:, b][out[:, b]].astype("<u4").tobytes(), marks[b], places[:, b]) for b in range(n)]


def decode(words: np.ndarray, states: np.ndarray, places: np.ndarray, steps: int, table: Table) -> np.ndarray:
    """Ids of segments of ``steps`` steps, one for each row of ``states``, which begin at ``places`` of ``words``."""
    x, at = states.astype(np.uint64), places.astype(np.int64)
    out = np.zeros((len(x), steps, LANES), np.uint32)
    low = np.uint64((1 << SCALE) - 1)
    padded = np.concatenate((words, np.zeros(LANES + 1, np.uint32)))
    for t in range(steps):
        slot = x & low
        s = table.symbol[slot.astype(np.int64)]
        out[:, t] = s
        x = table.freq[s] * (x >> np.uint64(SCALE)) + slot - table.start[s]
        need = x < _LOW
        rank = np.cumsum(need, axis=1)
        took = padded[np.minimum(at[:, None] + rank - 1, len(padded) - 1)]
        x = np.where(need, (x << np.uint64(32)) | took, x)
        at += rank[:, -1]
    return out.reshape(len(x), steps * LANES)


def file_bytes(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, table: Table) -> bytes:
    """A whole file for documents in order; the last block is filled up with the most frequent id."""
    fill = int(np.argmax(table.freq))
    size = len(ids)
    padded = np.full(-(-size // BLOCK) * BLOCK, fill, np.uint32)
    padded[:size] = ids
    rows = padded.reshape(-1, BLOCK)
    parts, index, at = [MAGIC], [], len(MAGIC)
    for k in range(0, len(rows), GROUP // BLOCK):
        for row, (words, states, places) in zip(rows[k:], encode(rows[k : k + GROUP // BLOCK], table), strict=False):
            index.append(struct.pack("<QIII", at, len(words), zlib.crc32(words), zlib.crc32(row.astype("<u4").tobytes())) + states.astype("<u8").tobytes() + places.astype("<u4").tobytes())
            parts.append(words)
            at += len(words)
    head = struct.pack("<QQQ", len(doc_ids), len(index), size)
    body = zlib.compress(head + doc_ids.astype("<i8").tobytes() + counts.astype("<u4").tobytes() + b"".join(index), 3)
    return b"".join([*parts, body, struct.pack("<QQII", at, len(body), zlib.crc32(body), table.crc)])


def read_file(data: bytes, table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, token counts, ids) of a file; raises ValueError where a checksum is wrong."""
    at, size, crc, own = struct.unpack("<QQII", data[-24:])
    body = data[at : at + size]
    if data[:8] != MAGIC or zlib.crc32(body) != crc or own != table.crc:
        raise ValueError("not a token file, or one of another table, or its index is damaged")
    raw = zlib.decompress(body)
    n_docs, n_blocks, n_ids = struct.unpack("<QQQ", raw[:24])
    docs = np.frombuffer(raw, "<i8", n_docs, 24)
    counts = np.frombuffer(raw, "<u4", n_docs, 24 + 8 * n_docs)
    marks = BLOCK // LANES // STEPS
    entry = np.dtype([("at", "<u8"), ("size", "<u4"), ("crc", "<u4"), ("ids_crc", "<u4"), ("states", "<u8", (marks, LANES)), ("places", "<u4", marks)])
    blocks = np.frombuffer(raw, entry, n_blocks, 24 + 12 * n_docs)
    out = np.zeros((n_blocks, BLOCK), np.uint32)
    for k in range(0, n_blocks, GROUP // BLOCK):
        part = blocks[k : k + GROUP // BLOCK]
        first, end = int(part["at"][0]), int(part["at"][-1] + part["size"][-1])
        for b in part:
            if zlib.crc32(data[b["at"] : b["at"] + b["size"]]) != b["crc"]:
                raise ValueError("a block's words are damaged")
        base = ((part["at"] - np.uint64(first)) // np.uint64(4)).astype(np.int64)
        places = base[:, None] + part["places"]
        ids = decode(np.frombuffer(data, "<u4", (end - first) // 4, first), part["states"].reshape(-1, LANES), places.reshape(-1), STEPS, table)
        out[k : k + len(part)] = ids.reshape(len(part), BLOCK)
        for b, row in zip(part, out[k:], strict=False):
            if zlib.crc32(row.astype("<u4").tobytes()) != b["ids_crc"]:
                raise ValueError("a block decodes to other ids")
    return docs, counts, out.reshape(-1)[:n_ids]


def _tokenised(path: str, end_id: int, cuts: histsort.Ranges):
    """Rows (part, doc_id, n, ids) and, from each task, its counts of ids as a row with part -1; ids are zlib-compressed 16- or 32-bit numbers."""

    def rows(batches):
        counts = np.zeros(1, np.int64)
        for batch in batches:
            docs, ties = batch.column(0), batch.column(2).to_numpy()
            for first, end, ids, at in encoder(path).column(batch.column(1)):
                ids = ids.astype(np.uint32)
                own = np.bincount(ids, minlength=end_id + 1)
                own[end_id] += end - first
                counts = np.resize(np.pad(counts, (0, max(0, len(own) - len(counts)))), max(len(own), len(counts)))
                counts[: len(own)] += own
                who = docs.slice(first, end - first)
                part = cuts.of(who.to_numpy(), ties[first:end])
                blobs = [zlib.compress(np.append(ids[at[k] : at[k + 1]], end_id).astype("<u4").reshape(-1, 1).view("<u2").T.tobytes(), 1) for k in range(end - first)]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), who, pa.array(ties[first:end]), pa.array(blobs, pa.binary())], ["part", "doc_id", "tie", "ids"])
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([counts.astype("<i8").tobytes()], pa.binary())], ["part", "doc_id", "tie", "ids"])

    return rows


def _unpacked(blob: bytes) -> np.ndarray:
    halves = np.frombuffer(zlib.decompress(blob), "<u2").reshape(2, -1).astype(np.uint32)
    return halves[0] | (halves[1] << np.uint32(16))


def _listed(batches):
    """(id, n) of the counts that tasks have sent, a row for each id."""
    for batch in batches:
        for blob in batch.column(0):
            n = np.frombuffer(blob.as_py(), "<i8")
            ids = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(n[ids])], ["id", "n"])


def _writer(folder: str, table, roll: int):
    """Writes one file for each part among a task's sorted rows, under a temporary name first; a rerun writes the same bytes again."""

    def rows(batches):
        from pyspark import TaskContext

        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        state: dict = {"part": None, "seq": 0, "size": 0, "docs": [], "ids": []}
        tag = f".{TaskContext.get().taskAttemptId()}.tmp"

        def close():
            counts = np.array([len(x) for x in state["ids"]], np.int64)
            data = file_bytes(np.array(state["docs"], np.int64), counts, np.concatenate(state["ids"]), table.value)
            name = f"tokens-{state['part']:06d}-{state['seq']:05d}.rans"
            with fs.open_output_stream(posixpath.join(root, name + tag)) as f:
                f.write(data)
            fs.move(posixpath.join(root, name + tag), posixpath.join(root, name))
            return pa.RecordBatch.from_pylist([{"part": state["part"], "seq": state["seq"], "file": name, "n_docs": len(counts), "n_tokens": int(counts.sum()), "bytes": len(data), "crc32": zlib.crc32(data)}], _MANIFEST)

        for batch in batches:
            for part, doc, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if state["docs"] and (part != state["part"] or state["size"] >= roll):
                    yield close()
                    state |= {"docs": [], "ids": [], "size": 0, "seq": state["seq"] + 1}
                if part != state["part"]:
                    state |= {"part": part, "seq": 0}
                state["docs"].append(doc)
                state["ids"].append(_unpacked(blob.as_py()))
                state["size"] += len(state["ids"][-1])
        if state["docs"]:
            yield close()

    return rows


_MANIFEST = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("bytes", pa.int64()), ("crc32", pa.int64())])


def _reader(folder: str, table):
    def rows(batches):
        fs, root = filesystem(folder)
        for batch in batches:
            for name, crc, start in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                with fs.open_input_stream(posixpath.join(root, name)) as f:
                    data = f.read()
                if zlib.crc32(data) != crc:
                    raise ValueError(f"{name} is not the file of the manifest")
                docs, counts, ids = read_file(data, table.value)
                at = np.concatenate(([0], np.cumsum(counts.astype(np.int64))))
                raw = ids.astype("<u4").tobytes()
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(start + at[:-1]), pa.array(counts.astype(np.int64)), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, file_bytes_target: int = FILE_BYTES, roll_ids: int = ROLL_IDS) -> tuple[str, Table, DataFrame]:
    """(folder, table, manifest): all documents as token files in ascending id order, with ``end_id`` after each.

    The manifest (part, seq, file, n_docs, n_tokens, bytes, crc32) is written last, so that a folder with one is complete.
    Null texts are empty. Rows that repeat an id follow each other, by a hash of
    their texts; rows without an id are left out, as they have no place in
    the order. An empty table gives no files. Other columns are never read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    rows = rows.withColumn("tie", F.xxhash64(F.coalesce("text", F.lit(""))))
    sizes = rows.select("doc_id", "tie", F.coalesce(F.octet_length("text") + 16, F.lit(16)).cast("long").alias("size"))
    cuts = histsort.key_ranges(sizes, "doc_id", "tie", "size", file_bytes_target)
    coded = written(rows.mapInArrow(memory.lean(_tokenised(path, end_id, cuts), keeps=True), "part int, doc_id long, tie long, ids binary").withColumn("kind", F.when(F.col("part") < 0, 1).otherwise(0)), "ids", ["kind"])
    # one row for each id of the vocabulary
    sums = {r.id: r.n for r in coded.where("kind = 1").select("ids").mapInArrow(_listed, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}
    counts = np.zeros(max(sums, default=0) + 1, np.int64)
    counts[list(sums)] = list(sums.values())
    table = Table.of(counts)
    shared, folder = spark.sparkContext.broadcast(table), shared_dir(spark)
    dealt = coded.where("kind = 0").select("part", "doc_id", "ids", "tie").repartitionById(len(cuts), "part").sortWithinPartitions("part", "doc_id", "tie")
    manifest = dealt.mapInArrow(memory.lean(_writer(folder, shared, roll_ids)), "part int, seq int, file string, n_docs long, n_tokens long, bytes long, crc32 long")
    manifest.write.parquet(posixpath.join(folder, "_manifest"))
    return folder, table, spark.read.schema(manifest.schema).parquet(posixpath.join(folder, "_manifest"))


def read_tokens(spark, folder: str, table: Table, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files of the manifest."""
    held = spark.sparkContext.broadcast(table)
    # one row for each file: a running sum and number over names and sizes only
    order = Window.orderBy("part", "seq")
    files = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("k", (F.row_number().over(order) - 1).cast("int"))
    count = max(1, min(manifest.count(), MOST_READERS))
    return files.select("file", "crc32", "start", (F.col("k") % count).alias("k")).repartitionById(count, "k").mapInArrow(memory.lean(_reader(folder, held)), "doc_id long, start long, n_tokens long, ids_crc32 long")
