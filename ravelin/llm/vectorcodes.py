"""Vector compression by product codes: float32 screening with rigorous error intervals, exact integers where intervals overlap.

Components are integers (floor of SCALE times the value), so distances are exact integers. For the entries of a codebook, the
distance to a part less the part's own square is ``|c|^2 - 2 x.c``. One float32 matrix product gives it for all entries, with an
error that is bounded beforehand; only entries whose interval overlaps the best one are evaluated again in integers, and ties
go to the smaller index. Tasks send sums by entry, so a round costs one pass over the vectors and a shuffle of codebook size.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm import memory
from ravelin.llm.store import written

#: What components are scaled by, parts of a vector, entries of a part's codebook, rounds of refinement.
SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Rows that are worked on at once.
BLOCK_ROWS = 4096
#: Labels whose sums are broadcast at most; of more, sums are joined by label and salt.
MOST_LABELS, SALTS = 1_000_000, 32
#: Sums travel as signed limbs of this many bits, so no sum of a task or a column overflows.
LIMB_BITS = 40
#: Unit roundoff of float32.
UNIT = 2.0**-24


def integers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of finite values: int64 where all results fit well, else Python integers."""
    scaled = np.floor(values * SCALE)
    if not len(scaled) or np.abs(scaled).max() < 2**52:
        return scaled.astype(np.int64)
    whole = [int(x) * SCALE if abs(x) >= 2**52 else math.floor(x * SCALE) for x in values.ravel().tolist()]
    return np.array(whole, dtype=object).reshape(values.shape)


def finite_rows(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of the vectors of ``length`` components that hold neither null, infinity nor NaN."""
    fits = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), length), False).to_numpy(zero_copy_only=False))
    values = column.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fits), length)
    sound = np.isfinite(values).all(axis=1)
    return fits[sound], values[sound]


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance) of every point, exactly; ties go to the smaller index.

    With d components, the screened score is off by at most gamma(d + 4) * (|c|^2 + 2 |x| |c|): two roundings of the inputs, d of the
    product, one of |c|^2 and one of the difference; gamma(d + 8) also covers the float64 arithmetic of the bound itself. A score that
    overflows says nothing, so all entries of its point are evaluated.
    """
    d = points.shape[1]
    p64, e64 = points.astype(np.float64), entries.astype(np.float64)
    gamma = (d + 8) * UNIT / (1 - (d + 8) * UNIT)
    with np.errstate(over="ignore", invalid="ignore"):
        square = (e64 * e64).sum(axis=1)
        score = square.astype(np.float32) - np.float32(2) * (p64.astype(np.float32) @ e64.astype(np.float32).T)
        slack = gamma * (square + 2 * np.sqrt((p64 * p64).sum(axis=1))[:, None] * np.sqrt(square))
        near = score - slack <= (score + slack).min(axis=1)[:, None]
        near[~np.isfinite(score + slack).all(axis=1)] = True
    row, entry = np.nonzero(near)
    most = max((abs(int(f(x))) for x in (points, entries) for f in (np.min, np.max) if x.size), default=0)
    if 4 * d * most * most >= 1 << 62:
        points, entries = points.astype(object), entries.astype(object)
    apart = points[row] - entries[entry]
    distance = (apart * apart).sum(axis=1)
    first = np.flatnonzero(np.diff(row, prepend=-1))
    least = np.minimum.reduceat(distance, first)
    hit = np.flatnonzero(distance == np.repeat(least, np.diff(first, append=len(row))))
    _, of_row = np.unique(row[hit], return_index=True)
    return entry[hit[of_row]], least


def _blocks(batches, length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(batch, places, integer parts: row x part x position) of the kept vectors, a block of rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            block = batch.slice(at, BLOCK_ROWS)
            rows, values = finite_rows(block.column("vector"), length)
            if len(rows):
                yield block, rows, integers(values).reshape(len(rows), PARTS, length // PARTS)


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """(number, signed value) of the limbs whose weighted sum is ``value``."""
    k, edge = 0, 1 << LIMB_BITS
    while not -edge <= value < edge:
        yield k, value & (edge - 1)
        value >>= LIMB_BITS
        k += 1
    yield k, value


def _lengths(vectors: DataFrame) -> DataFrame:
    """(id, length) of vectors without null or non-finite components; PARTS divides the length."""

    def found(batches):
        for batch in batches:
            column = batch.column("vector")
            ids, sizes = batch.column("id"), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            for length in np.unique(sizes[(sizes > 0) & (sizes % PARTS == 0)]).tolist():
                rows, _ = finite_rows(column, length)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(np.full(len(rows), length, np.int32))], names=["id", "length"])

    return vectors.select("id", "vector").mapInArrow(memory.lean(found), "id long, length int")


def _first_book(vectors: DataFrame, length: int, ids: list[int]) -> np.ndarray:
    """Part x entry x position: the parts of the vectors with the given ids; of several vectors with one id, the smallest counts."""

    def finite(batches):
        for batch in batches:
            rows, _ = finite_rows(batch.column("vector"), length)
            yield batch.take(pa.array(rows))

    some = vectors.where(F.col("id").isin(ids)).select("id", "vector")
    rows = some.mapInArrow(memory.lean(finite), some.schema).groupBy("id").agg(F.min("vector").alias("vector")).orderBy("id").collect()
    whole = integers(np.array([r.vector for r in rows], np.float64))
    return whole.reshape(len(rows), PARTS, length // PARTS).transpose(1, 0, 2)


def _refined(vectors: DataFrame, length: int, book: np.ndarray) -> np.ndarray:
    """The codebook after one round: floor(sum / count) of the parts assigned to each entry."""

    def sums(batches):
        count, total = np.zeros(book.shape[:2], np.int64), np.zeros(book.shape, object)
        for _, _, parts in _blocks(batches, length):
            for k in range(PARTS):
                code, _ = nearest(parts[:, k], book[k])
                order = np.argsort(code, kind="stable")
                used, first = np.unique(code[order], return_index=True)
                count[k] += np.bincount(code, minlength=book.shape[1])
                total[k, used] += np.add.reduceat(parts[order, k], first, axis=0).astype(object)
        rows = [(k, e, -1, 0, n) for (k, e), n in np.ndenumerate(count) if n]
        rows += [(k, e, i, limb, v) for (k, e, i), x in np.ndenumerate(total) if count[k, e] for limb, v in _limbs(int(x))]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate([pa.int32()] * 4 + [pa.int64()])], names=["part", "entry", "at", "limb", "value"])

    sent = vectors.select("vector").mapInArrow(memory.lean(sums), "part int, entry int, at int, limb int, value long")
    found = {}
    # at most PARTS x ENTRIES x (positions + 1) numbers of a few limbs, whatever the input
    for r in sent.groupBy("part", "entry", "at", "limb").agg(F.sum("value").alias("value")).collect():
        found[r.part, r.entry, r["at"]] = found.get((r.part, r.entry, r["at"]), 0) + (r.value << LIMB_BITS * r.limb)
    out = book.astype(object)
    for (k, e, i), x in found.items():
        if i >= 0:
            out[k, e, i] = x // found[k, e, -1]
    return out if max(abs(x) for x in out.ravel()) >= 2**52 else out.astype(np.int64)


def codebook(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", rounds: int = ROUNDS) -> np.ndarray | None:
    """Part x entry x position: the trained codebooks; None without a vector that can be kept.

    The start is the parts of the vectors of the ENTRIES smallest ids (fewer if there are fewer). Vectors of the most frequent length
    that PARTS divides count (of equally frequent lengths, the smaller); vectors of other lengths, null vectors and those with null,
    infinite or NaN components don't. Rows without an id are no start but refine like others, and repeated rows count each time.
    """
    vectors = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    sound = written(_lengths(vectors), "lengths")
    most = sound.groupBy("length").count().orderBy(F.desc("count"), "length").first()
    if most is None:
        return None
    ids = [r.id for r in sound.where(F.col("length") == most.length).where("id is not null").select("id").distinct().orderBy("id").limit(ENTRIES).collect()]
    if not ids:
        return None
    book = _first_book(vectors, most.length, ids)
    for _ in range(rounds):
        book = _refined(vectors, most.length, book)
    return book


def digest(book: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for x in book.ravel()).encode()).hexdigest()


def encode(rows: DataFrame, book: np.ndarray, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, code, error) of every vector that fits the book: two hex digits a part, and the squared distance over all parts
    (null beyond a long)."""
    length = PARTS * book.shape[2]

    def coded(batches):
        for block, places, parts in _blocks(batches, length):
            codes, error = np.empty((len(places), PARTS), np.uint8), np.zeros(len(places), object)
            for k in range(PARTS):
                codes[:, k], apart = nearest(parts[:, k], book[k])
                error += apart.astype(object)
            text, kept = codes.tobytes().hex(), block.take(pa.array(places))
            names = [text[at : at + 2 * PARTS] for at in range(0, len(text), 2 * PARTS)]
            yield pa.RecordBatch.from_arrays([kept.column("id"), kept.column("label"), pa.array(names, pa.string()), pa.array([x if x < 1 << 63 else None for x in error], pa.int64())], names=["id", "label", "code", "error"])

    some = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    return some.mapInArrow(memory.lean(coded), f"id long, label {some.schema['label'].dataType.simpleString()}, code string, error long")


def with_label_error(coded: DataFrame, most_labels: int = MOST_LABELS) -> DataFrame:
    """``coded`` (read more than once, so a written table) with the error summed over equal labels, nulls together; null where a
    sum doesn't fit a long. Sums combine before the shuffle; up to ``most_labels`` they are broadcast, else each is joined in SALTS
    copies, so that a label of a third of all rows is no single task."""
    sums = coded.groupBy("label").agg(F.when(F.count("error") == F.count(F.lit(1)), F.try_sum("error")).alias("label_error")).withColumnRenamed("label", "_label")
    sums = written(sums, "label_errors")
    same = F.col("label").eqNullSafe(F.col("_label"))
    if sums.count() <= most_labels:
        return coded.join(F.broadcast(sums), same).drop("_label")
    copies = sums.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int")
    return coded.withColumn("_salt", salt).join(copies, same & (F.col("_salt") == F.col("_copy"))).drop("_label", "_salt", "_copy")


def compressed(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector that is kept.

    Null vectors, vectors with null, infinite or NaN components, and vectors of other than the most frequent length that PARTS divides
    are dropped (see ``codebook``). A null label is a label. Rows without an id are coded, repeated rows are coded each, ties between
    entries go to the smaller index, components of any finite size are exact, an empty table gives no rows, and other columns are
    never read. Texts play no part.
    """
    spark, result = rows.sparkSession, "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    book = codebook(rows, id_col, vector_col, rounds)
    if book is None:
        return spark.createDataFrame([], result)
    found = with_label_error(written(encode(rows, book, id_col, vector_col, label_col), "codes"))
    return found.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(book)).alias("codebooks_sha256"))
