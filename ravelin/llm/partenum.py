"""Exact Jaccard self-join of word-shingle sets by PartEnum signatures.

Two sets of sizes a and b with Jaccard similarity of 3/4 or more differ in k <= (a + b) / 7 elements. The shingle domain is cut in
two levels, by a table over size bands (``BANDS``): n1 groups of n2 partitions. A group that holds at most k2 of the differing elements
has n2 - k2 partitions that are equal in both sets, so one of its C(n2, k2) subsets of partitions is a signature that both sets have.
A set enumerates the subsets of its first groups, as many as k differing elements can't all spoil; a group all of whose elements lie
in one partition can be spoiled by one element and counts once, any other counts k2 + 1 times. Groups of rare shingles come first
(the domain is cut by classes of a count sketch before it is cut by hash), which keeps passages that many documents share out of most
signatures. The sketch has a fixed size and decides about speed only.

Equal sets are one set from the start, with the number of documents that have it. Sets that share a signature form a bucket; buckets
with the same smallest member (its pivot) form one cluster, which is compared in full: first by count vectors, whose distance never
exceeds the number of differing elements, then what is left on the whole sets. Clusters are compared in cells of bounded size, as
matrices, so neither pairs of a bucket nor links of a group become rows. A pair that meets in several clusters is counted in the
one with the smallest pivot.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ravelin.llm import memory, textops
from ravelin.llm.graph import components
from ravelin.llm.store import id_bitmap, in_bitmap, slot, written

#: Bits of a cell's number in the count sketch (4 bytes a cell, so 16 MiB in all) and the pieces in which tasks send it.
SKETCH_BITS, SKETCH_PARTS = 22, 16
#: Ratio of the largest to the smallest size of a band.
BAND_RATIO = 4
#: (largest size of the band, groups per element of the largest size, partitions of a group, partitions that may differ: 0 or 1). In
#: the bands of the first line each element is a group of its own.
BANDS = [(64, 1 << 55, 1, 0), (1 << 40, 0.25, 3, 1)]
#: Limits of the classes of shingles, as multiples of twice the mean count of a sketch cell plus 8.
CLASSES = (1, 4, 32)
#: Signatures whose shingles are all counted this often (and twice the mean) are dealt to pieces of this many sets.
HOT_COUNT = 1000
#: Keys of sets that a task remembers, to give the signatures of equal texts once; beyond it starts anew.
REMEMBERED = 1 << 20
#: Sets and shingles of a block in which a cluster is compared in full, and the ratio of sizes in one of its levels (above 4/3, so
#: that linked sets lie in the same or in neighbouring levels).
BLOCK, BLOCK_SHINGLES, SIZE_STEP = 512, 1 << 20, 1.34
#: Shingles whose counts are added at once.
COLUMNS = 2048


def shingle_sets(column: pa.Array, key: tuple[int, int], width: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct 64-bit shingles) of each text, by the run's secret ``key``; a text of fewer words has its whole sequence as one
    shingle."""
    for first, end, data, offsets in textops.chunks(column):
        starts, ends, at = textops.words(data, offsets, textops.SPACE_SEP)
        hashes = textops.span_hashes(data, starts, ends, key=key)
        runs = textops.windows(hashes, width)
        for row in range(first, end):
            a, b = at[row - first], at[row - first + 1]
            if b - a >= width:
                yield row, np.unique(runs[a : b - width + 1])
            elif b > a:
                yield row, np.array([textops.whole_run(hashes[a:b])], np.uint64)
            else:
                yield row, np.empty(0, np.uint64)


def _print(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


def _key(name: bytes) -> int:
    return int.from_bytes(name[:8], "little", signed=True)


def tally(own: np.ndarray) -> np.ndarray:
    """Counts of the set's elements by hash, in a power of two of cells of one byte (4 elements a cell at most on average)."""
    cells = 1 << max(6, (max(len(own) - 1, 1) >> 2).bit_length())
    return np.bincount((own & np.uint64(cells - 1)).astype(np.int64), minlength=cells).clip(0, 255).astype(np.uint8)


def folded(counts: np.ndarray, cells: int) -> np.ndarray:
    """Rows of tallies brought to fewer cells. Clipping and adding never make a distance larger than the number of differing elements."""
    while counts.shape[1] > cells:
        half = counts.shape[1] // 2
        counts = (counts[:, :half].astype(np.uint16) + counts[:, half:]).clip(0, 255).astype(np.uint8)
    return counts


_FIELDS = ["doc_id", "n", "print", "key", "tally", "sketch", "part"]
_PROFILE = "doc_id long, n long, print binary, key long, tally binary, sketch binary, part int"


class _Remembered(set):
    def new(self, key: int) -> bool:
        if key in self:
            return False
        if len(self) >= REMEMBERED:
            self.clear()
        self.add(key)
        return True


def _profiles(secret: tuple[int, int]):
    def rows(batches):
        sketch, seen = np.zeros(1 << SKETCH_BITS, np.uint32), _Remembered()
        for batch in batches:
            found = []
            for _, own in shingle_sets(batch.column(1), secret):
                if not len(own):
                    found.append((0, None, None, None))
                    continue
                name = _print(own)
                if seen.new(_key(name)):
                    np.add.at(sketch, (own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
                found.append((len(own), name, _key(name), tally(own).tobytes()))
            n = len(batch)
            columns = [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.int64(), pa.binary(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32())], _FIELDS)
        if sketch.any():
            n, parts = SKETCH_PARTS, sketch.reshape(SKETCH_PARTS, -1)
            none = [pa.nulls(n, kind) for kind in (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, pa.array([zlib.compress(x.tobytes(), 1) for x in parts], pa.binary()), pa.array(range(n), pa.int32())], _FIELDS)

    return rows


def _added(batches):
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            total = totals.setdefault(part, np.zeros((1 << SKETCH_BITS) // SKETCH_PARTS, np.uint64))
            total += np.frombuffer(zlib.decompress(x.as_py()), np.uint32)
    packed = [zlib.compress(x.clip(0, 2**32 - 1).astype(np.uint32).tobytes(), 1) for x in totals.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array(packed, pa.binary())], ["part", "sketch"])


def _band(top: int) -> tuple[int, int, int]:
    """(n1, n2, k2) of the band with this largest size."""
    for largest, groups, parts, differ in BANDS:
        if top <= largest:
            return int(groups * top) if groups < 1 else groups, parts, differ
    raise ValueError(f"no band for sets of {top} shingles")


def limits(sketch: np.ndarray) -> np.ndarray:
    """Counts at which the classes of shingles end."""
    return np.array(CLASSES) * (2 * float(sketch.mean()) + 8)


def signatures(own: np.ndarray, sketch: np.ndarray, ends: np.ndarray, finer: int = 1) -> tuple[np.ndarray, np.ndarray] | None:
    """(signatures, counts of their rarest shingles) of a set, in the band of its size and, where it has larger partners there, in the next;
    ``ends`` are the ``limits`` of the sketch.

    None if the groups don't suffice for the differing elements that must be borne (a matter of bad luck with the hash); the
    caller then cuts the whole domain ``finer``.
    """
    size, level = len(own), 0
    while BAND_RATIO ** (level + 1) < size:
        level += 1
    top, largest = BAND_RATIO ** (level + 1), size * 4 // 3
    counts = sketch[(own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.int64)
    kinds = np.searchsorted(ends, counts).astype(np.uint64)
    sigs, rarest = [], []
    for lev, most in [(level, min(largest, top))] + ([(level + 1, largest)] if largest > top else []):
        differ = (size + most) // 7
        n1, n2, k2 = _band(BAND_RATIO ** (lev + 1))
        n1 *= finer
        mixed = textops.mixed(own ^ np.uint64(0x51ED270B * (lev + 1)))
        group = kinds * np.uint64(n1) + mixed % np.uint64(n1)
        part = group * np.uint64(n2) + textops.mixed(mixed) % np.uint64(n2) if n2 > 1 else group
        order = np.argsort(part, kind="stable")
        part, group = part[order], group[order]
        content, counted = textops.mixed(own[order] + np.uint64(0x632BE59BD9B4E019)), counts[order]
        # sums of contents by partition, then by group
        starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        sums, group = np.add.reduceat(content, starts), group[starts]
        heads = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        filled = np.diff(np.append(heads, len(group)))
        enough = int(np.searchsorted(np.cumsum(np.where(filled > 1, k2 + 1, 1)), differ, side="right")) + 1
        if enough > len(heads):
            return None
        whole, rare = np.add.reduceat(sums, heads)[:enough], np.minimum.reduceat(counted, starts[heads])[:enough]
        tag = textops.mixed(group[heads[:enough]] + np.uint64(lev * 0x9E3779B97F4A7C15 % (1 << 64)))
        # subsets of n2 - k2 partitions: without each of the filled ones in turn, and without an empty one
        filled = filled[:enough]
        full = filled < n2 if k2 else np.ones(enough, bool)
        sigs.append(textops.mixed(whole[full] ^ tag[full]))
        rarest.append(rare[full])
        if k2:
            of = np.repeat(np.arange(enough), filled)
            left_out = np.flatnonzero(filled[of] > 1)
            of = of[left_out]
            sigs.append(textops.mixed((whole[of] - sums[left_out]) ^ tag[of]))
            rarest.append(rare[of])
    return np.concatenate(sigs), np.concatenate(rarest)


def _signature_rows(sketch, finer: int, secret: tuple[int, int]):
    def rows(batches):
        counts, seen = np.frombuffer(sketch.value, np.uint32), _Remembered()
        hot, ends = HOT_COUNT + 2 * int(counts.mean()), limits(counts)
        held, size = [], 0
        for batch in batches:
            for _, own in shingle_sets(batch.column(0), secret):
                if not len(own) or not seen.new(key := _key(_print(own))):
                    continue
                if (found := signatures(own, counts, ends, finer)) is None:
                    held.append((np.zeros(1, np.uint64), np.array([-1], np.int32), np.zeros(1, np.int64)))
                    continue
                sigs, rarest = found
                salts = np.where(rarest > hot, 1 + key % (1 + rarest // hot), 0).astype(np.int32)
                held.append((sigs, salts, np.full(len(sigs), key, np.int64)))
                size += len(sigs)
                if size > 1 << 17:
                    yield _sent(held)
                    held, size = [], 0
        if held:
            yield _sent(held)

    return rows


def _sent(held):
    sigs, salts, keys = map(np.concatenate, zip(*held, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(sigs.view(np.int64)), pa.array(salts), pa.array(keys)], ["sig", "salt", "key"])


def _picked(bits):
    def rows(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["id", "text"]).filter(pa.array(in_bitmap(batch.column(2).to_numpy(), bits.value)))

    return rows


def _buckets(docs: DataFrame, sketch, secret: tuple[int, int]) -> DataFrame:
    """(sig, key, first, last, salt) of the signatures that two sets or more may share."""
    finer = 1
    while True:
        sigs = docs.where("id is not null").select("text").mapInArrow(memory.lean(_signature_rows(sketch, finer, secret)), "sig long, salt int, key long")
        own = Window.partitionBy("sig", "salt")
        shared = sigs.withColumn("first", F.min("key").over(own)).withColumn("last", F.max("key").over(own)).where("first <> last or salt <> 0")
        buckets = written(shared, "buckets")
        if buckets.where("salt < 0").isEmpty():
            return buckets
        finer *= 2


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row of ``docs``: groups linked by a similarity of 0.75 or more.

    Null, empty and wordless texts have no shingles and are alone. Rows that repeat an id stay rows; the id is linked where any
    of its texts is. A row without an id gets its size and no component. ``n_links`` is the number of other ids whose text is
    equal or similar. An empty table gives no rows; other columns are never read.
    """
    spark, secret = docs.sparkSession, textops.new_key()
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = written(docs.mapInArrow(memory.lean(_profiles(secret)), _PROFILE).withColumn("kind", F.when(F.col("part").isNull(), 0).otherwise(1)), "profiles", ["kind"])
    profile = found.where("kind = 0").select("doc_id", "n", "print", "key", "tally")
    counts = np.zeros((SKETCH_PARTS, (1 << SKETCH_BITS) // SKETCH_PARTS), np.uint32)
    for r in found.where("kind = 1").select("part", "sketch").repartition("part").mapInArrow(_added, "part int, sketch binary").collect():
        counts[r.part] = np.frombuffer(zlib.decompress(r.sketch), np.uint32)
    sketch = spark.sparkContext.broadcast(counts.tobytes())
    buckets = _buckets(docs, sketch, secret)
    sketch.destroy()

    # the pieces of a hot bucket have one pivot
    hot = written(buckets.where("salt > 0").groupBy("sig").agg(F.min("first").alias("pivot"), F.max("last").alias("last")).where("pivot <> last"), "hot")
    cold = buckets.where("salt = 0").select(F.col("first").alias("pivot"), "key")
    members = written(cold.union(buckets.where("salt > 0").select("sig", "key").join(hot, "sig").select("pivot", "key")).distinct(), "members")

    # each id with each of its sets; sets with their smallest id and the number of ids that have no other set
    ids = written(profile.where("doc_id is not null and n > 0").select(F.col("doc_id").alias("id"), "n", "print", "key").distinct(), "ids")
    several = written(ids.groupBy("id").count().where("count > 1").select("id"), "several")
    held = ids.join(several.withColumn("many", F.lit(True)), "id", "left").withColumn("many", F.coalesce("many", F.lit(False)))
    held = written(held, "held") if not several.isEmpty() else ids.withColumn("many", F.lit(False))
    sets = held.groupBy("print").agg(F.min("id").alias("rep"), F.min("n").alias("n"), F.min("key").alias("key"), F.sum((~F.col("many")).cast("long")).alias("docs"), F.max("many").alias("marked"))
    sets = written(sets.withColumn("level", F.floor(F.log("n") / F.lit(float(np.log(SIZE_STEP)))).cast("int")), "sets")
    tallies = profile.where("doc_id is not null").join(members.select("key").distinct(), "key", "left_semi").groupBy("print").agg(F.max("tally").alias("tally"))

    rows = members.join(sets.select("print", "n", "key", "level"), "key").select("pivot", "print", "n", "level")
    rows = written(rows.join(tallies, "print"), "tallied")
    near = _in_cells(rows, ["tally"]).mapInArrow(memory.lean(_plausible), "pivot long, print binary").distinct()
    near = written(near.join(sets, "print"), "plausible")
    # a pair is counted in the cluster with the smallest of its common pivots
    pivots = near.groupBy("print").agg(F.collect_set("pivot").alias("pivots"))
    near = near.join(pivots, "print").withColumn("lesser", F.expr("array_sort(filter(pivots, x -> x < pivot))")).drop("pivots")
    near = written(near, "near")
    ends = near.select(F.col("rep").alias("id")).distinct()
    bits = spark.sparkContext.broadcast(id_bitmap(ends, "id"))
    texts = docs.where("id is not null").withColumn("slot", slot("id")).mapInArrow(_picked(bits), "id long, text string").join(ends, "id", "left_semi")
    links = _in_cells(near, ["rep", "docs", "marked", "lesser"], texts).mapInArrow(memory.lean(_counted(secret)), "print binary, other binary, links long, a long, b long")
    links = written(links, "links")
    bits.destroy()

    edges = links.where("a is not null").select("a", "b")
    if not several.isEmpty():
        edges = edges.union(held.where("many").select("id", "print").join(sets.select("print", "rep"), "print").select(F.col("id").alias("a"), F.col("rep").alias("b")))
    roots = written(components(edges), "roots")
    total = links.where("links is not null").groupBy("print").agg(F.sum("links").alias("links"))
    # what is more than a text of its own
    special = sets.join(total, "print", "left").join(roots, F.col("rep") == F.col("id"), "left")
    special = special.where("docs > 1 or links is not null or marked or id is not null")
    special = written(special.select(F.col("print").alias("_print"), "marked", "docs", F.coalesce("root", "rep").alias("root"), (F.col("docs") + F.coalesce("links", F.lit(0))).alias("reached")), "special")
    other = None
    if not several.isEmpty():
        special, other = _of_several(special, links, held, several)
    out = profile.select("doc_id", F.col("n").alias("n_shingles"), "print").join(special, F.col("print") == F.col("_print"), "left")
    out = out.withColumn("n_links", F.coalesce(F.col("reached") - 1, F.lit(0)).cast("long"))
    if other is not None:
        out = out.join(other, "doc_id", "left").withColumn("n_links", F.coalesce("all_links", "n_links"))
    there = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    return out.select("doc_id", "n_shingles", F.when(there, F.coalesce("root", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(there, F.col("n_links")).otherwise(0).cast("long").alias("n_links"))


def _of_several(special: DataFrame, links: DataFrame, held: DataFrame, several: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``special`` with the ids that have several texts counted, and (doc_id, all_links) of those ids.

    Such an id may be reached by more than one of its texts, so its links are listed and counted by id.
    """
    marked = special.where("marked").select(F.col("_print").alias("print"))
    near = written(links.where("other is not null").select("print", "other").union(marked.select("print", F.col("print").alias("other"))).distinct(), "near")
    far = written(held.where("many").select(F.col("id").alias("far"), F.col("print").alias("other")), "far")
    reach = near.join(far, "other").select("print", "far").distinct().groupBy("print").agg(F.count("*").alias("more"))
    mine = written(far.select(F.col("far").alias("id"), F.col("other").alias("print")).join(near, "print").select("id", "other").distinct(), "mine")
    single = mine.join(special.select(F.col("_print").alias("other"), "docs"), "other").select("id", "docs")
    others = mine.join(far, "other").where("id <> far").select("id", "far").distinct().select("id", F.lit(1).cast("long").alias("docs"))
    other = written(single.union(others).groupBy(F.col("id").alias("doc_id")).agg(F.sum("docs").alias("all_links")), "other")
    special = special.join(reach, F.col("_print") == F.col("print"), "left").withColumn("reached", F.col("reached") + F.coalesce("more", F.lit(0))).drop("print", "more")
    return written(special, "special"), other


def _in_cells(rows: DataFrame, fields: list[str], texts: DataFrame | None = None) -> DataFrame:
    """Rows (pivot, print, n, level, fields) dealt to cells, sorted so that the rows of a cell are together: pivot, the cell's four
    numbers, side, print, n, the fields and, if given, the text.

    A cluster of up to BLOCK sets and BLOCK_SHINGLES shingles is one cell; a larger one is cut into levels by size and blocks by
    hash, and every pair of blocks of the same or of neighbouring levels is a cell, so each pair of sets meets once.
    """
    parts = F.ceil(F.greatest(F.count("*") / F.lit(float(BLOCK)), F.sum("n") / F.lit(float(BLOCK_SHINGLES)))).cast("int")
    levels = rows.groupBy("pivot", "level").agg(parts.alias("blocks"), F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    large = levels.groupBy("pivot").agg(F.sum("sets").alias("sets"), F.sum("shingles").alias("shingles"), F.map_from_entries(F.collect_list(F.struct("level", "blocks"))).alias("levels"))
    large = written(large.where((F.col("sets") > BLOCK) | (F.col("shingles") > BLOCK_SHINGLES) & (F.col("sets") > 2)).select("pivot", "levels"), "large")
    dealt = rows.join(large, "pivot", "left").withColumns({"blocks": F.expr("levels[level]"), "up": F.expr("coalesce(levels[level + 1], 0)"), "down": F.expr("coalesce(levels[level - 1], 0)")})
    dealt = dealt.withColumn("block", F.expr("cast(pmod(xxhash64(print), blocks) as int)")).drop("levels")
    cell = "named_struct('la', {}, 'ia', {}, 'lb', {}, 'ib', {}, 'side', {})".format
    none = "filter(array({}), x -> false)".format(cell("0", "0", "0", "0", "0"))
    some = "if({0} > 0, transform(sequence(0, greatest({0}, 1) - 1), k -> {1}), {2})".format
    within = some("blocks", cell("level", "least(block, k)", "level", "greatest(block, k)", "if(k = block, 2, if(block < k, 0, 1))"), none)
    above, below = some("up", cell("level", "block", "level + 1", "k", "0"), none), some("down", cell("level - 1", "k", "level", "block", "1"), none)
    cells = f"if(blocks is null, array({cell('0', '0', '0', '0', '2')}), concat({within}, {above}, {below}))"
    key = ["pivot", "la", "ia", "lb", "ib"]
    if texts is not None:
        dealt, fields = dealt.join(texts, F.col("rep") == F.col("id")), [*fields, "text"]
    rows = dealt.select("pivot", "print", "n", *fields, F.explode(F.expr(cells)).alias("cell")).select("pivot", "cell.*", "print", "n", *fields)
    return rows.repartition(*key).sortWithinPartitions(*key)


def _plausible_ones(sides: tuple[list, list, list]) -> set[bytes]:
    """Prints of a cell's sets that have a partner by size and tally; ``sides`` hold (print, n, tally)."""
    left, right = (sides[2], sides[2]) if sides[2] else (sides[0], sides[1])
    if not left or not right or len(sides[2]) == 1:
        return set()
    stacked = {}
    for cells in {len(x[2]) for x in right}:
        rows = [k for k, x in enumerate(right) if len(x[2]) == cells]
        stacked[cells] = np.array(rows), np.array([right[k][1] for k in rows]), np.stack([right[k][2] for k in rows])
    good, partners = np.zeros(len(left), bool), np.zeros(len(right), bool)
    for k, (_, n, own) in enumerate(left):
        for cells, (rows, sizes, counts) in stacked.items():
            fits = (4 * np.minimum(sizes, n) >= 3 * np.maximum(sizes, n)) & ~(good[k] & partners[rows])
            if left is right:
                fits &= rows != k
            if not fits.any():
                continue
            fewer = min(cells, len(own))
            apart = np.abs(folded(counts[fits], fewer).astype(np.int16) - folded(own[None, :], fewer).astype(np.int16)).sum(1, dtype=np.int64)
            close = rows[fits][7 * apart <= sizes[fits] + n]
            if len(close):
                good[k] = True
                partners[close] = True
                if left is right:
                    good[close] = partners[k] = True
    return {x[0] for x, one in zip(left, good, strict=True) if one} | {x[0] for x, one in zip(right, partners, strict=True) if one}


def _plausible(batches):
    """Rows (pivot, la, ia, lb, ib, side, print, n, tally) by cell; gives (pivot, print) of the sets that may have a link there."""
    now, sides = None, ([], [], [])

    def sent(found):
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.binary())], ["pivot", "print"])

    for batch in batches:
        cells = list(zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True))
        which, prints, sizes, tallies = (batch.column(k).to_pylist() for k in range(5, 9))
        found: list[tuple] = []
        for row, cell in enumerate(cells):
            if cell != now:
                found += [(now[0], x) for x in _plausible_ones(sides)] if now else []
                now, sides = cell, ([], [], [])
            sides[which[row]].append((prints[row], sizes[row], np.frombuffer(tallies[row], np.uint8)))
        yield sent(found)
    if now:
        yield sent([(now[0], x) for x in _plausible_ones(sides)])


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Number of common elements of each set of ``left`` with each of ``right``."""
    values = [np.concatenate(x) for x in (left, right)]
    rows = [np.repeat(np.arange(len(x)), [len(own) for own in x]) for x in (left, right)]
    known = np.intersect1d(*values)
    if left is right:
        # an element of one set only is common to no two
        found, times = np.unique(values[0], return_counts=True)
        known = found[times > 1]
    out = np.zeros((len(left), len(right)), np.int64)
    if not len(known):
        return out
    places = []
    for value, row in zip(values, rows, strict=True):
        at = np.minimum(np.searchsorted(known, value), len(known) - 1)
        same = known[at] == value
        order = np.argsort(at[same], kind="stable")
        places.append((at[same][order], row[same][order]))
    for first in range(0, len(known), COLUMNS):
        both = []
        for (at, row), own in zip(places, (left, right), strict=True):
            a, b = np.searchsorted(at, (first, first + COLUMNS))
            one = np.zeros((len(own), min(COLUMNS, len(known) - first)), np.float32)
            one[row[a:b], at[a:b] - first] = 1
            both.append(one)
        out += (both[0] @ both[1].T).astype(np.int64)
    return out


def _local_roots(linked: np.ndarray) -> np.ndarray:
    """The first member of each row's connected part of a symmetric boolean matrix."""
    root = np.full(len(linked), -1)
    for k in range(len(linked)):
        if root[k] >= 0:
            continue
        part = np.zeros(len(linked), bool)
        part[k], edge = True, np.array([k])
        while len(edge):
            new = linked[edge].any(0) & ~part
            part |= new
            edge = np.flatnonzero(new)
        root[part] = k
    return root


def _cell_links(sides: tuple[dict, dict, dict]) -> Iterator[tuple]:
    """Of the sets of a cell: (print, null, documents it is linked to, null, null); (print, other, null, null, null) both ways for
    links of marked sets; and (null, null, null, a, b) for ids that are connected.

    ``sides`` hold (shingles, id, documents, mark, smaller pivots) by print: the first two are compared with each other, or all of the third.
    """
    one, other = (sides[2], sides[2]) if sides[2] else (sides[0], sides[1])
    if not one or not other or len(sides[2]) == 1:
        return
    a, b = list(one.values()), list(other.values())
    left = [x[0] for x in a]
    same = _shared(left, left if one is other else [x[0] for x in b])
    union = np.array([len(x[0]) for x in a])[:, None] + np.array([len(x[0]) for x in b])[None, :] - same
    linked = (same > 0) & (100 * same >= 75 * union)
    if one is other:
        np.fill_diagonal(linked, False)
    if not linked.any():
        return
    ids = [x[1] for x in a] + ([] if one is other else [x[1] for x in b])
    whole = linked if one is other else np.block([[np.zeros((len(a), len(a)), bool), linked], [linked.T, np.zeros((len(b), len(b)), bool)]])
    for k, root in enumerate(_local_roots(whole).tolist()):
        if root != k:
            yield None, None, None, ids[k], ids[root]
    # links that another cluster counts
    met = [x[4] for x in a]
    linked &= _shared(met, met if one is other else [x[4] for x in b]) == 0
    for names, found, weights in ((one, linked, b), (other, linked.T, a))[: 1 if one is other else 2]:
        for name, hits, n in zip(names, found.sum(1).tolist(), (found @ np.array([x[2] for x in weights])).tolist(), strict=True):
            if hits:
                yield name, None, n, None, None
    marks = [np.array([x[3] for x in side]) for side in (a, b)]
    names, others = list(one), list(other)
    for i, k in np.argwhere(linked & (marks[0][:, None] | marks[1][None, :])):
        yield names[i], others[k], None, None, None
        if one is not other:
            yield others[k], names[i], None, None, None


def _counted(secret: tuple[int, int]):
    """Rows (pivot, la, ia, lb, ib, side, print, n, rep, docs, marked, lesser, text) by cell; gives the rows of ``_cell_links``."""

    def rows(batches):
        now, sides = None, ({}, {}, {})

        def sent(found):
            kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds)], ["print", "other", "links", "a", "b"])

        for batch in batches:
            cells = list(zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True))
            which, prints, _, reps, docs, marked, lesser = (batch.column(k).to_pylist() for k in range(5, 12))
            found: list[tuple] = []
            for row, own in shingle_sets(batch.column(12), secret):
                if cells[row] != now:
                    found += _cell_links(sides)
                    now, sides = cells[row], ({}, {}, {})
                # an id may have other texts, too
                if _print(own) == prints[row]:
                    sides[which[row]][prints[row]] = (own, reps[row], docs[row], marked[row], np.array(lesser[row], np.int64))
            yield sent(found)
        yield sent(list(_cell_links(sides)))

    return rows
