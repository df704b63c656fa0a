"""Spelling variants by full neighbourhoods: every string one edit away from a word is looked up among all words.

Words are counted with Spark. Then each word emits all distinct deletions, replacements and insertions over the alphabet that the words
themselves use, and the candidates are hash-joined with the words: a hit is a word at distance one by construction, so nothing is
verified afterwards. A candidate's hash follows from the word's prefix sums in one step, so candidates that aren't in a Bloom filter
of all words are dropped before they become strings. The filter has a bounded size and only saves work: the join alone decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm import memory
from ravelin.llm.store import written
from ravelin.llm.textops import mixed

#: Shortest word in code points, fewest occurrences, which runs lose a code point, how much larger a form's count is.
LEAST_LETTERS, LEAST_COUNT, DAMAGED, FORM_FACTOR = 5, 3, 97, 2
#: Bits of the filter: for each word, at least, at most (32 MiB), and how many a word sets at most.
BITS_A_WORD, LEAST_BITS, MOST_BITS, MOST_PROBES = 32, 1 << 16, 1 << 28, 8
#: Words whose neighbourhoods are one task.
TASK_WORDS = 10_000
#: Candidates that are hashed at once; rows and letters of an emitted batch.
CELLS, BATCH_ROWS, BATCH_LETTERS = 1 << 20, 50_000, 1 << 22
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Base of the hashes and its inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of words with LEAST_LETTERS code points and LEAST_COUNT occurrences at least.

    Only runs of LEAST_LETTERS code points or more can give such a word, so only those are taken. A row without an id damages runs as if
    its id were the empty string.
    """
    text = F.translate(F.col(text_col).cast("string"), _UPPER, _LOWER)
    runs = F.regexp_extract_all(text, F.lit(r"[a-zÀ-ÿ]{%d,}" % LEAST_LETTERS), F.lit(0))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    cut = F.pmod(F.col("h"), F.length("run")).cast("int")
    lost = F.concat(F.substring("run", F.lit(1), cut), F.substring("run", cut + 2, F.length("run")))
    words = rows.withColumn("h", h).select(F.when(F.col("h") % DAMAGED == 0, lost).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


class Filter:
    """A Bloom filter over polynomial hashes; ``has`` is never false for a member."""

    def __init__(self, words: int):
        self.bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_A_WORD * words - 1).bit_length()))
        self.probes = max(1, min(MOST_PROBES, round(0.69 * self.bits / max(words, 1))))
        self.data = b""

    def _places(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        """The bit of each hash, probe after probe."""
        yield (hashes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(65 - self.bits.bit_length())
        at, step = mixed(hashes), mixed(~hashes)
        for _ in range(self.probes - 1):
            at = at + step
            yield at & np.uint64(self.bits - 1)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        return np.concatenate(list(self._places(hashes)))

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """Indices of the hashes that may be members."""
        table, left = np.frombuffer(self.data, np.uint8), np.arange(len(hashes))
        first = next(self._places(hashes))
        left = left[(table[first >> np.uint64(3)] >> (first & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        for k, at in enumerate(self._places(hashes[left])):
            if not k:
                alive = np.ones(len(left), bool)
            alive &= (table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return left[alive]


def by_length(words: pa.Array) -> Iterator[tuple[list[str], np.ndarray]]:
    """(words of one length, their code points as a matrix)."""
    found: dict[int, list[str]] = {}
    for w in words.to_pylist():
        found.setdefault(len(w), []).append(w)
    for n, same in found.items():
        yield same, np.frombuffer("".join(same).encode("utf-32-le"), "<u4").reshape(len(same), n)


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n, _BASE, np.uint64))))


def _prefixes(codes: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Hashes of all prefixes, the empty and the whole one included."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    np.cumsum(mixed(codes.astype(np.uint64)) * powers[: codes.shape[1]], axis=1, dtype=np.uint64, out=out[:, 1:])
    return out


def word_hashes(codes: np.ndarray) -> np.ndarray:
    return _prefixes(codes, _powers(codes.shape[1]))[:, -1]


def candidates(codes: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(edit, row, place, letter, hash) of all distinct strings one edit away from the rows of ``codes``, a piece at a time.

    Of equal neighbours only the first can be deleted, and a letter is inserted behind an equal one only at the front, so that no
    string comes twice; the three edits give strings of three lengths, or of one place that differs.
    """
    n = codes.shape[1]
    powers, letters = _powers(n + 1), mixed(alphabet.astype(np.uint64))
    for top in range(0, len(codes), max(1, CELLS // (n * len(alphabet)))):
        own = codes[top : top + max(1, CELLS // (n * len(alphabet)))]
        before = _prefixes(own, powers)
        whole, terms = before[:, -1:], np.diff(before, axis=1)
        fresh = np.ones(own.shape, bool)
        fresh[:, 1:] = own[:, 1:] != own[:, :-1]
        row, place = np.nonzero(fresh)
        yield "delete", top + row, place, place, (before[:, :-1] + (whole - before[:, 1:]) * _INVERSE)[row, place]
        pieces = max(1, CELLS // (len(own) * len(alphabet)))
        for p in range(0, n, pieces):
            at = slice(p, min(n, p + pieces))
            row, place, letter = np.nonzero(own[:, at, None] != alphabet)
            yield "replace", top + row, p + place, letter, ((whole - terms[:, at])[:, :, None] + letters * powers[at, None])[row, place, letter]
        shifted = before + (whole - before) * np.uint64(_BASE)
        for p in range(0, n + 1, pieces):
            at = slice(p, min(n + 1, p + pieces))
            apart = np.ones((len(own), at.stop - p, len(alphabet)), bool)
            skip = int(p == 0)
            apart[:, skip:] = own[:, p + skip - 1 : at.stop - 1, None] != alphabet
            row, place, letter = np.nonzero(apart)
            yield "insert", top + row, p + place, letter, (shifted[:, at, None] + letters * powers[at, None])[row, place, letter]


def edited(word: str, edit: str, place: int, letter: str) -> str:
    if edit == "insert":
        return word[:place] + letter + word[place:]
    return word[:place] + ("" if edit == "delete" else letter) + word[place + 1 :]


def _alphabet(words: DataFrame) -> np.ndarray:
    """All code points of the words; their class has 90."""
    rows = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("letter")).distinct().collect()
    return np.array(sorted(ord(r.letter) for r in rows if r.letter), np.uint32)


def _filter(spark: SparkSession, words: DataFrame) -> Filter:
    """The filter of all words; the driver receives its bits, at most MOST_BITS, in rows of 4 KiB."""
    out = Filter(words.count())

    def places(batches):
        for batch in batches:
            for _, codes in by_length(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(out.places(word_hashes(codes)).astype(np.int64))], names=["bit"])

    bits = words.select("word").mapInArrow(memory.lean(places), "bit long")
    data = bytearray(out.bits // 8)
    for r in bits.groupBy(F.expr("bit div 32768").alias("bucket")).agg(F.bitmap_construct_agg(F.expr("bit % 32768")).alias("bits")).collect():
        data[r.bucket * 4096 : (r.bucket + 1) * 4096] = r.bits
    out.data = bytes(data)
    return out


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near, n of near) of all words that differ by one inserted, deleted or replaced code point, in both directions.

    ``words`` (word, n) are distinct and read more than once, so a written table.
    """
    spark = words.sparkSession
    alphabet = _alphabet(words)
    shared = spark.sparkContext.broadcast((_filter(spark, words), alphabet, [chr(c) for c in alphabet]))

    def emitted(batches):
        filter_, codes_of, letters = shared.value
        left, right, size = [], [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], names=["word", "near"])

        for batch in batches:
            for same, codes in by_length(batch.column(0)):
                for edit, row, place, letter, hashes in candidates(codes, codes_of):
                    hit = filter_.hits(hashes)
                    for r, p, a in zip(row[hit].tolist(), place[hit].tolist(), letter[hit].tolist()):
                        left.append(same[r])
                        right.append(edited(same[r], edit, p, letters[a] if edit != "delete" else ""))
                        size += 2 * len(same[r])
                        if len(left) >= BATCH_ROWS or size >= BATCH_LETTERS:
                            yield flush()
                            left, right, size = [], [], 0
        if left:
            yield flush()

    dealt = words.select("word").repartition(words.count() // TASK_WORDS + 1, "word")
    emits = dealt.mapInArrow(memory.lean(emitted), "word string, near string")
    return emits.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word with a form: the end of its chain of forms.

    Each round doubles the reach of every word; counts at least double along a chain, so rounds are few and end.
    """
    reach = written(forms.select("word", F.col("form").alias("root")), "reach")
    while True:
        on = reach.select(F.col("word").alias("root"), F.col("root").alias("further"))
        further = written(reach.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "reach")
        if further.where("moved").isEmpty():
            return reach
        reach = further.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``docs``; see ``word_counts`` for what a word is.

    A word's form is its near word of largest n, of equal ones the smallest in code-point order, if that n is at least FORM_FACTOR times
    the word's; root is the end of its chain of forms, or the word. Null, empty and short texts have no words, repeated rows count each
    time, words and texts of any length are taken whole, an empty table gives no rows, and other columns are never read.
    """
    words = written(word_counts(docs, id_col, text_col), "words")
    best = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    larger = -F.col("best.less") >= FORM_FACTOR * F.col("n")
    found = words.join(best, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(larger, F.col("best.form")).alias("form"),
        F.when(larger, -F.col("best.less")).alias("form_n"),
    )
    found = written(found, "forms")
    return found.join(roots(found.where("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
