"""Quality rules of single documents, carried over to their hosts with an empirical beta prior."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm import memory, textops
from ravelin.llm.store import written

#: Symbols that are counted, fewest words, and the largest share of words in repeated windows (in hundredths).
SYMBOLS, LEAST_WORDS, MOST_REPEATED = b"#*$%&|<>", 10, 20
#: A host goes when its shrunk failure rate is above this, whatever the single document looks like.
HOST_LIMIT = 0.5
_WINDOW = 5
_IS_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))


def text_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """Per text: n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, over the whole texts; null counts as empty."""
    out = {k: np.zeros(len(column), np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    for first, end, data, offsets in textops.chunks(column):
        if not len(data):
            continue
        starts, ends, at = textops.words(data, offsets, textops.SPACE_SEP)
        rows = slice(first, end)
        lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))  # code points begin at bytes that don't continue one
        symbols = np.concatenate(([0], np.cumsum(_IS_SYMBOL[data])))
        chars = np.concatenate(([0], np.cumsum(lead[ends] - lead[starts])))
        out["n_words"][rows] = np.diff(at)
        out["word_chars"][rows] = chars[at[1:]] - chars[at[:-1]]
        out["n_symbols"][rows] = symbols[offsets[1:]] - symbols[offsets[:-1]]
        out["n_dup_lines"][rows] = _duplicate_lines(data, offsets, starts)
        # case counts in repeated windows, so words are hashed as they stand
        runs = textops.windows(textops.span_hashes(data, starts, ends, fold=False), _WINDOW)
        for row in range(first, end):
            a, b = at[row - first], at[row - first + 1]
            if b - a > _WINDOW:
                own = runs[a : b - _WINDOW + 1]
                _, which, times = np.unique(own, return_inverse=True, return_counts=True)
                again = np.flatnonzero(times[which] > 1)
                if len(again):
                    covered = np.zeros(b - a + 1, np.int32)
                    np.add.at(covered, again, 1)
                    np.add.at(covered, again + _WINDOW, -1)
                    out["n_repeat_words"][row] = np.count_nonzero(np.cumsum(covered[:-1]) > 0)
    return out


def _duplicate_lines(data: np.ndarray, offsets: np.ndarray, word_starts: np.ndarray) -> np.ndarray:
    """Per text, the lines with a word that equal an earlier line."""
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.sort(np.concatenate((offsets[:-1], breaks + 1)))
    ends = np.sort(np.concatenate((breaks, offsets[1:])))
    # an empty text and a break at a text's end make empty lines; all lines pair up in order, as texts don't overlap
    text = np.searchsorted(offsets, starts, side="right") - 1
    has_word = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
    starts, ends, text = starts[has_word], ends[has_word], text[has_word]
    keys = textops.span_hashes(data, starts, ends, fold=False) ^ textops.mixed(text.astype(np.uint64))
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(keys), bool)
    again[1:] = keys[order][1:] == keys[order][:-1]
    return np.bincount(text[order][again], minlength=len(offsets) - 1)


def _counted(batches):
    for batch in batches:
        counts = text_counts(batch.column(2))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(x) for x in counts.values())], [*batch.schema.names[:-1], *counts])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(doc_id, host, counts, base_failed) of every row; see ``text_counts``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("_text"))
    out = rows.mapInArrow(memory.lean(_counted), "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    return out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def host_verdicts(counts: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """(host, n_docs, n_failed, host_rate, host_kept): failure rates by host, shrunk towards a beta prior fitted to all hosts.

    The prior's mean and strength come from the moments of the hosts' rates: the variance between hosts beyond what chance
    gives at their sizes. Documents without a host share one group, which is never rejected. Counting is a map-side-combined
    aggregate, so a host with a third of all rows costs no more than others.
    """
    hosts = written(counts.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed")), "hosts")
    rate = F.col("n_failed") / F.col("n_docs")
    # one row: the moments of all hosts
    m = hosts.agg(F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f"), F.count("*").alias("hosts"), F.avg(rate).alias("mean"), F.var_samp(rate).alias("var"), F.avg(1 / F.col("n_docs")).alias("inv")).first()
    mean = min(max((m["f"] or 0) / (m["n"] or 1), 1e-6), 1 - 1e-6)
    between = (m["var"] or 0.0) - mean * (1 - mean) * (m["inv"] or 1.0)
    strength = max(mean * (1 - mean) / between - 1, 1.0) if between > 1e-9 else 1e6
    shrunk = (F.col("n_failed") + mean * strength) / (F.col("n_docs") + strength)
    return hosts.withColumn("host_rate", shrunk).withColumn("host_kept", (shrunk <= limit) | F.col("host").isNull())


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rate, kept) of every row.

    ``kept`` is false for a document that fails a base rule, and for all documents of a host whose shrunk failure rate is above
    ``limit``. Null, empty and wordless texts fail (fewer than 10 words). Repeated rows and ids stay rows of their own, ties
    can't occur, an empty table gives no rows, and columns besides the three named ones are never read.
    """
    counts = written(measured(docs, id_col, text_col, host_col), "counts")
    hosts = written(host_verdicts(counts, limit), "verdicts")
    # hosts can be many, so Spark chooses the join by their size; a hot host's rows are read from a written table and split
    out = counts.join(hosts.select(F.col("host").alias("_host"), "host_rate", "host_kept"), F.col("host").eqNullSafe(F.col("_host")), "left")
    return out.withColumn("kept", ~F.col("base_failed") & F.col("host_kept")).drop("_host", "host_kept")


def _flagged(at: int, name: str, drop: bool):
    def rows(batches):
        for batch in batches:
            c = text_counts(batch.column(at))
            failed = (c["n_words"] < LEAST_WORDS) | (100 * c["n_repeat_words"] > MOST_REPEATED * c["n_words"])
            columns, names = (batch.columns[:at] + batch.columns[at + 1 :], batch.schema.names[:at] + batch.schema.names[at + 1 :]) if drop else (batch.columns, batch.schema.names)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(failed)], [*names, name])

    return rows


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """The rows of ``docs`` that ``judged`` keeps, with all their columns and without a shuffle of their texts.

    The rows are judged once and written with their verdicts, from which those of the hosts are counted. Columns may have any
    names; null, empty and wordless texts go, repeated rows stay rows, and an empty table gives no rows.
    """
    failed, host = (memory.free_name(docs.columns, x) for x in ("failed", "gone_host"))
    if dict(docs.dtypes)[text_col] == "string":
        rows, at, drop = docs, docs.columns.index(text_col), False
    else:
        rows, at, drop = docs.withColumn(memory.free_name([*docs.columns, failed, host], "as_text"), F.col(text_col).cast("string")), len(docs.columns), True
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{failed}` boolean"
    seen = written(rows.mapInArrow(memory.lean(_flagged(at, failed, drop)), schema), "flagged")
    verdicts = host_verdicts(seen.select(F.col(host_col).cast("string").alias("host"), F.col(failed).alias("base_failed")), limit)
    # only the hosts that go are joined, and Spark picks the join by their size
    gone = written(verdicts.where(~F.col("host_kept")).select(F.col("host").alias(host)), "gone")
    good = seen.where(~F.col(failed))
    return good.join(gone, good[host_col].cast("string") == gone[host], "left_anti").select(*docs.columns)
