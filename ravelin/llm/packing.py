"""Best-fit packing of token sequences with certified bin counts.

Every partition packs its pieces best-fit decreasing and holds its bin count against dual-feasible-function lower bounds.
While all bins together exceed the bound over all pieces, the pieces of bins with room are exchanged (dealt anew over fewer,
larger partitions) and packed again; full bins are settled. It ends when the bound is met, when one partition holds all open
pieces, or when the largest partitions save nothing any more.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm import memory
from ravelin.llm.store import written
from ravelin.llm.tokens import encoder

#: Tokens of a sequence, the id that ends a document.
CAPACITY, END_ID = 1024, 2
#: Pieces that a partition packs at first, and at most; partitions at first, unless these would be larger than the most; how much larger
#: partitions are after each exchange.
FIRST_ROWS, PARTITION_ROWS, FIRST_PARTS, GROWTH = 2_000, 100_000, 4096, 4


def _cut(path: str, capacity: int, end_id: int, with_ids: bool):
    def rows(batches):
        for batch in batches:
            docs = batch.column(0)
            for first, end, ids, at in encoder(path).column(batch.column(1)):
                row, piece, start, length, crc, whole = [], [], [], [], [], []
                for r in range(first, end):
                    own = np.append(ids[at[r - first] : at[r - first + 1]], end_id).astype("<u4")
                    n = len(own)
                    # a longer document: the remainder first, then whole pieces
                    edges = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                        row.append(r)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(own[a:b]))
                        whole.append(own[a:b].astype(np.int32) if with_ids else None)
                columns = (piece, start, length, crc, whole)
                yield pa.RecordBatch.from_arrays([docs.take(pa.array(row, pa.int64())), *(pa.array(x, f.type) for x, f in zip(columns, list(_PIECE)[1:], strict=True))], schema=_PIECE)

    return rows


_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))])


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids) of every document: its token ids and ``end_id``, cut only if longer than
    ``capacity``, where the first piece may be shorter. A null text is empty: one piece with the end id. ``ids`` is null unless asked for."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(memory.lean(_cut(path, capacity, end_id, with_ids), keeps=True), "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>")


def lower_bound(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """The best of two families of dual feasible functions: no packing of ``counts[length]`` pieces has fewer bins."""
    lengths = np.arange(len(counts), dtype=np.int64)
    total = int((counts * lengths).sum())
    best = -(-total // capacity)
    # pieces above capacity - a fill a bin, those of at least a share it, smaller ones vanish
    many, mass = np.concatenate(([0], np.cumsum(counts))), np.concatenate(([0], np.cumsum(counts * lengths)))
    for a in range(1, capacity // 2 + 1):
        large = many[capacity + 1] - many[capacity - a + 1]
        best = max(best, int(large) + -(-int(mass[capacity - a + 1] - mass[a]) // capacity))
    # rounding to multiples of 1 / k
    for k in range(1, 24):
        whole = (k + 1) * lengths % capacity == 0
        value = np.where(whole, lengths * k, (k + 1) * lengths // capacity * capacity)
        best = max(best, -(-int((counts * value).sum()) // (capacity * k)))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each piece and the room left in each bin, best-fit decreasing."""
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    present, room = 0, []
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = present >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = by_room[left].pop()
            if not by_room[left]:
                present &= ~(1 << left)
        else:
            b, left = len(room), capacity
            room.append(capacity)
        where[i], offset[i] = b, capacity - left
        left -= size
        room[b] = left
        by_room[left].append(b)
        present |= 1 << left
    return where, offset, np.array(room, np.int64)


def _packed(capacity: int, turn: int):
    def rows(batches):
        held = [b for b in batches if len(b)]
        if not held:
            return
        from pyspark import TaskContext

        table = pa.Table.from_batches(held).combine_chunks()
        lengths = table.column("length").to_numpy()
        where, offset, room = best_fit(lengths, capacity)
        certified = len(room) == lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        base = (turn << 56) + (TaskContext.get().partitionId() << 32)
        table = table.append_column("sequence_id", pa.array(base + where)).append_column("offset", pa.array(offset))
        table = table.append_column("room", pa.array(room[where])).append_column("certified", pa.array(np.full(len(where), certified)))
        yield from table.to_batches(max_chunksize=20_000)

    return rows


def packed(parts: DataFrame, capacity: int = CAPACITY, partition_rows: int = PARTITION_ROWS, first_rows: int = FIRST_ROWS) -> DataFrame:
    """The written ``pieces`` with (sequence_id, offset, room, certified): as few sequences of ``capacity`` tokens as the bounds ask for, or near it.

    Repeated rows are packed each on their own, ties go by the order of rows in a partition, and an empty table gives no rows.
    A partition holds about ``first_rows`` rows of a few numbers at first, ``partition_rows`` at most, never texts or ids of others.
    """
    schema = [f for f in parts.schema.fields]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", sequence_id long, offset long, room long, certified boolean"
    # at most one row for each length; the driver holds nothing that grows with the input
    lengths = parts.groupBy("length").agg(F.count("*").alias("n")).collect()
    counts = np.zeros(capacity + 1, np.int64)
    for r in lengths:
        counts[r.length] = r.n
    bound, last, turn, out, left = lower_bound(counts, capacity), None, 0, [], parts
    n_left, settled, size, before = int(counts.sum()), 0, first_rows, None
    while n_left:
        n = max(1, -(-n_left // min(partition_rows, max(size, n_left // FIRST_PARTS))))
        dealt = left.repartition(n, F.xxhash64("doc_id", "piece", F.lit(turn)))
        now = written(dealt.mapInArrow(memory.lean(_packed(capacity, turn)), ddl), f"packed{turn}")
        stats = now.groupBy((F.col("room") == 0).alias("full")).agg(F.count_if(F.col("offset") == 0).alias("bins"), F.count("*").alias("n")).collect()
        bins = settled + sum(r.bins for r in stats)
        if last is not None and bins > last:
            out.append(before.where("room > 0"))  # what there was is better
            break
        if bins <= bound or n == 1 or (size >= partition_rows and bins == last):
            out.append(now)
            break
        out.append(now.where("room = 0"))
        settled += next((r.bins for r in stats if r.full), 0)
        left, n_left = now.where("room > 0").select(*parts.columns), next((r.n for r in stats if not r.full), 0)
        last, before, turn, size = bins, now, turn + 1, size * GROWTH
    whole = out[0] if out else parts.mapInArrow(_packed(capacity, 0), ddl)
    for x in out[1:]:
        whole = whole.union(x)
    return whole


def packed_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document; see ``pieces`` and ``packed``.

    Rows without an id are packed like others, and other columns are never read.
    """
    cut = written(pieces(docs, path, id_col, text_col, capacity, end_id).drop("ids"), "pieces")
    return packed(cut, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified")


def sequences(placed: DataFrame, with_ids: DataFrame) -> DataFrame:
    """(sequence_id, ids): the filled sequences, from placed pieces and ``pieces(..., with_ids=True)`` joined by document and piece."""
    rows = placed.join(with_ids.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    # a sequence holds at most its capacity of tokens, so the group has a bound
    whole = rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return whole.select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"))
