"""Finds benchmark passages in documents with a broadcast hash set of word windows, and removes them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm import memory, textops
from ravelin.llm.store import written

#: Words of a window.
WINDOW = 10
#: Windows that are broadcast with their words at most (about 100 bytes each, as arrays); a larger benchmark is broadcast as a bitmap of
#: its hashes, of this many bits whatever its size, and the windows that pass are joined with it.
MOST_WINDOWS, BITMAP_BITS = 500_000, 1 << 27


def _item_windows(width: int):
    def rows(batches):
        for batch in batches:
            items, words, lengths, hashes = [], [], [], []
            for first, end, data, offsets in textops.chunks(batch.column(1)):
                starts, ends, at = textops.words(data, offsets, textops.ALNUM_SEP)
                own = textops.span_hashes(data, starts, ends, key=textops.OPEN)
                raw = data.tobytes().lower()
                for row in range(first, end):
                    a, b = at[row - first], at[row - first + 1]
                    n = min(width, b - a)
                    for k in range(a, b - n + 1) if n else ():
                        items.append(batch.column(0)[row].as_py())
                        words.append(b" ".join(raw[starts[i] : ends[i]] for i in range(k, k + n)))
                        lengths.append(n)
                        hashes.append(int(textops.windows(own[k : k + n], n)[0]) - (1 << 63))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(words, pa.binary()), pa.array(lengths, pa.int32()), pa.array(hashes, pa.int64())], ["item_id", "words", "n", "hash"])

    return rows


def benchmark_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """(item_id, words, n, hash): every window of ``width`` words of every item; an item of fewer words is one window, an item of none has no window."""
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_item_windows(width), "item_id long, words binary, n int, hash long").distinct()


class WindowSet:
    """All windows of the benchmark as arrays, by length: sorted hashes, and the words and item of each."""

    def __init__(self, table: pa.Table):
        self.sorted, self.words, self.items = {}, {}, {}
        for n in sorted(set(table.column("n").to_pylist())):
            own = table.filter(pc.equal(table.column("n"), n))
            hashes = own.column("hash").to_numpy().astype(np.uint64) ^ np.uint64(1 << 63)
            order = np.argsort(hashes, kind="stable")
            self.sorted[n] = hashes[order]
            self.words[n] = own.column("words").combine_chunks().take(pa.array(order))
            self.items[n] = own.column("item_id").take(pa.array(order)).to_pylist()

    def hits(self, raw: bytes, starts, ends, hashes: np.ndarray, at: np.ndarray):
        """(text, first word, words, items) of each verified occurrence; ``raw`` is lower-cased."""
        for n, known in self.sorted.items():
            for t, k, place, own in _passed(hashes, at, n, lambda x, known=known: known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x):
                words = _spelled(raw, starts, ends, k, n)
                place = int(np.searchsorted(known, own))
                met, items = False, []
                while place < len(known) and known[place] == own:
                    if self.words[n][place].as_py() == words:
                        met = True
                        items += [] if self.items[n][place] is None else [self.items[n][place]]
                    place += 1
                if met:
                    yield t, k, n, items


def _passed(hashes: np.ndarray, at: np.ndarray, n: int, there):
    """(text, first word, place in its text, hash) of the windows of ``n`` words inside one text whose hash passes ``there``."""
    own = textops.windows(hashes, n)
    if not len(own):
        return
    found = np.flatnonzero(there(own))
    text = np.searchsorted(at, found, side="right") - 1
    inside = found + n <= at[text + 1]
    for k, t in zip(found[inside].tolist(), text[inside].tolist(), strict=True):
        yield t, k, k - int(at[t]), own[k]


def _spelled(raw: bytes, starts, ends, k: int, n: int) -> bytes:
    return b" ".join(raw[starts[i] : ends[i]] for i in range(k, k + n))


def _scanned(held):
    def rows(batches):
        for batch in batches:
            n_words = np.zeros(len(batch), np.int64)
            spans: list[list[int]] = [[] for _ in range(len(batch))]
            items: list[set[int]] = [set() for _ in range(len(batch))]
            for first, end, data, offsets in textops.chunks(batch.column(1)):
                starts, ends, at = textops.words(data, offsets, textops.ALNUM_SEP)
                n_words[first:end] = np.diff(at)
                hashes = textops.span_hashes(data, starts, ends, key=textops.OPEN)
                raw = data.tobytes().lower()
                for t, k, n, which in held.value.hits(raw, starts, ends, hashes, at):
                    items[first + t].update(which)
                    word, byte = k - at[t], offsets[t]
                    spans[first + t] += [int(word), int(word + n), int(starts[k] - byte), int(ends[k + n - 1] - byte)]
            rows = [_merged(x) for x in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(rows, pa.list_(pa.list_(pa.int64()))), pa.array([sorted(x) for x in items], pa.list_(pa.int64()))], ["doc_id", "n_words", "spans", "items"])

    return rows


def _merged(flat: list[int]) -> list[list[int]]:
    """Word and byte spans (first word, end word, first byte, end byte), joined where they overlap or touch."""
    out: list[list[int]] = []
    for a, b, c, d in sorted(zip(flat[0::4], flat[1::4], flat[2::4], flat[3::4], strict=True)):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1][1], out[-1][3] = b, d
        else:
            out.append([a, b, c, d])
    return out


def scan(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, spans, items) of every row of ``docs``: spans are [first word, end word, first byte, end byte].

    A benchmark of MOST_WINDOWS windows at most, which are counted first, is broadcast whole, and documents aren't shuffled; a
    larger one is found by ``_scanned_by_join``, with the same rows. Null, empty and wordless texts have no words and no hits, items
    without words never occur, items with equal texts are all found, and items without
    an id hit words but are named nowhere. Repeated rows of documents
    and rows without an id stay rows. Empty tables give no rows, or no hits. Other columns are never read.
    """
    grams = written(benchmark_windows(items, item_id, item_text, width), "windows")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if grams.count() <= MOST_WINDOWS:
        held = docs.sparkSession.sparkContext.broadcast(WindowSet(grams.toArrow()))
        return rows.mapInArrow(memory.lean(_scanned(held)), "doc_id long, n_words long, spans array<array<long>>, items array<long>")
    rows = written(rows.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text"), "rows")
    return rows.select("key", "doc_id").join(_scanned_by_join(rows.select("key", "text"), grams), "key").select("doc_id", "n_words", "spans", "items")


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITMAP_BITS.bit_length() + 1)).astype(np.int64)


def _passing(held):
    """Of rows (key, text): (key, number of words, nulls) of each, and (key, null, n, hash, words, span) of windows that are in the bitmap."""

    def rows(batches):
        lengths, bits = held.value
        bits = np.frombuffer(bits, np.uint8)
        there = lambda x: (bits[(slot := _slots(x)) >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for first, end, data, offsets in textops.chunks(batch.column(1)):
                starts, ends, at = textops.words(data, offsets, textops.ALNUM_SEP)
                hashes, raw = textops.span_hashes(data, starts, ends, key=textops.OPEN), data.tobytes().lower()
                found = [(keys[first + k], int(n), None, None, None, None) for k, n in enumerate(np.diff(at))]
                for n in lengths:
                    for t, k, word, own in _passed(hashes, at, n, there):
                        span = [word, word + n, int(starts[k] - offsets[t]), int(ends[k + n - 1] - offsets[t])]
                        found.append((keys[first + t], None, n, int(own) - (1 << 63), _spelled(raw, starts, ends, k, n), span))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], f.type) for k, f in enumerate(_CANDIDATE)], schema=_CANDIDATE)

    return rows


_CANDIDATE = pa.schema([("key", pa.int64()), ("n_words", pa.int64()), ("n", pa.int32()), ("hash", pa.int64()), ("words", pa.binary()), ("span", pa.list_(pa.int64()))])


def _scanned_by_join(rows: DataFrame, grams: DataFrame) -> DataFrame:
    """(key, n_words, spans, items) of every row (key, text), whose keys are unique, against a benchmark of any size.

    One scan of the texts holds all their windows against a bitmap of fixed size; those that pass are joined with the benchmark's
    windows by hash and words, and what is found in a row is united by its key.
    """
    spark = rows.sparkSession
    slot = F.shiftrightunsigned(F.expr("hash ^ -9223372036854775808L"), 64 - BITMAP_BITS.bit_length() + 1)
    bits = bytearray(BITMAP_BITS // 8)
    # at most BITMAP_BITS / 32768 rows of 4 KiB
    for r in grams.select(slot.alias("slot")).groupBy(F.expr("slot div 32768").alias("bucket")).agg(F.bitmap_construct_agg(F.expr("slot % 32768")).alias("bits")).collect():
        bits[r.bucket * 4096 : (r.bucket + 1) * 4096] = r.bits
    lengths = sorted(r.n for r in grams.select("n").distinct().collect())
    held = spark.sparkContext.broadcast((lengths, bytes(bits)))
    seen = written(rows.mapInArrow(memory.lean(_passing(held)), "key long, n_words long, n int, hash long, words binary, span array<long>"), "passing")
    held.destroy()
    hits = seen.where("n_words is null").drop("n_words").join(grams, ["n", "hash", "words"])
    # a group is what one text holds
    found = hits.groupBy("key").agg(F.flatten(F.collect_set("span")).alias("flat"), F.array_sort(F.collect_set("item_id")).alias("items"))
    found = written(found, "found")
    none = "array<array<long>>", "array<long>"
    out = seen.where("n_words is not null").select("key", "n_words").join(found, "key", "left")
    spans = F.when(F.col("flat").isNotNull(), _union_spans()(F.coalesce("flat", F.array().cast("array<long>")))).otherwise(F.array().cast(none[0]))
    return out.select("key", "n_words", spans.alias("spans"), F.coalesce("items", F.array().cast(none[1])).alias("items"))


def _union_spans():
    @F.pandas_udf("array<array<long>>")
    def union(spans):
        return spans.map(lambda x: _merged([int(v) for v in x]))

    return union


def report(found: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) from the rows of ``scan``."""
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def _cut(held, drop_share: float):
    def rows(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            own = next(_scanned(held)(iter([pa.RecordBatch.from_arrays([pa.array(range(len(batch))), texts], ["id", "text"])])))
            yield _without(batch, own.column(1), own.column(2), drop_share)

    return rows


def _cut_found(drop_share: float):
    """As ``_cut``, for rows that end with their number of words and their spans."""

    def rows(batches):
        for batch in batches:
            yield _without(batch.select(batch.schema.names[:-2]), batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1), drop_share)

    return rows


def _without(batch, n_words, spans, drop_share: float):
    """The rows of ``batch``, whose last column is the text, with the spans cut out; rows of which too much is hit go."""
    texts = batch.column(batch.num_columns - 1)
    data, offsets = textops.text_buffers(texts)
    new, keep = [], []
    for row, (n, own) in enumerate(zip(n_words.to_pylist(), spans.to_pylist(), strict=True)):
        hit = sum(s[1] - s[0] for s in own)
        keep.append(hit == 0 or hit <= drop_share * n)
        if not hit:
            new.append(texts[row].as_py())
            continue
        raw, at, out = data[offsets[row] : offsets[row + 1]].tobytes(), 0, []
        for _, _, a, b in own:
            out.append(raw[at:a])
            at = b
        new.append(b"".join([*out, raw[at:]]).decode())
    columns = [*batch.columns[:-1], pa.array(new, pa.string())]
    return pa.RecordBatch.from_arrays(columns, batch.schema.names).filter(pa.array(keep))


def cleaned(docs: DataFrame, items: DataFrame, text_col: str = "text", drop_share: float = 0.5, item_id: str = "item_id", item_text: str = "text", width: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` with all columns, without benchmark passages: hit spans are cut out of the text, and documents of
    which more than ``drop_share`` of the words are hit go. Texts are cut and judged once, by all their spans, however large the
    benchmark is. Columns may have any names; null texts and repeated rows stay as they are, and empty tables give no rows or no cuts."""
    grams = written(benchmark_windows(items, item_id, item_text, width), "windows")
    names = docs.columns
    text, key, words, spans = (memory.free_name(names, x) for x in ("clean_text", "row_key", "n_row_words", "row_spans"))
    columns = [*[F.col(f"`{c}`") for c in names if c != text_col], F.col(f"`{text_col}`").cast("string").alias(text)]
    if grams.count() <= MOST_WINDOWS:
        held = docs.sparkSession.sparkContext.broadcast(WindowSet(grams.toArrow()))
        rows = docs.select(*columns)
        out = rows.mapInArrow(memory.lean(_cut(held, drop_share)), rows.schema)
    else:
        rows = written(docs.select(F.monotonically_increasing_id().alias(key), *columns), "rows")
        found = _scanned_by_join(rows.select(F.col(key).alias("key"), F.col(text).alias("text")), grams)
        found = found.select(F.col("key").alias(key), F.col("n_words").alias(words), F.col("spans").alias(spans))
        joined = rows.join(found, key).drop(key)
        out = joined.mapInArrow(memory.lean(_cut_found(drop_share)), rows.drop(key).schema)
    return out.withColumnRenamed(text, text_col).select(*[F.col(f"`{c}`") for c in names])
