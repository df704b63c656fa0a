"""Histogram sort: exact counts below probe keys, refined until the splitters meet a tolerance, then one exchange.

Rows are ordered by the hash of their text and then by id, so equal texts stand together. Each round counts the exact bytes
between probes on a small written table (one row per document, no text), and keeps only the intervals that hold a wanted
boundary; the driver sees at most PROBES rows for each of them. A boundary goes between two texts where that is within the
tolerance, and only inside a group of equal texts (then by id) where the group is larger.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ravelin.llm.store import written

#: Probes in an interval and round; unequal share of a shard's bytes that is accepted (in thousandths); bins of the final numbering.
PROBES, TOLERANCE, BINS = 1024, 2, 4096


def _digests(id_col: str, text_col: str) -> list[Column]:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return [
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 2).alias("key"),
    ]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, key): size is the UTF-8 bytes of the text plus 1 (null: 1); equal texts have equal keys, from 0."""
    return docs.select(*_digests(id_col, text_col))


def _chained(cases: list[tuple[Column, Column]]) -> Column:
    return reduce(lambda w, c: w.when(*c), cases[1:], F.when(*cases[0]))


def probed(rows: DataFrame, key: str, weight: str, wanted: list[float], tolerance: float) -> list[dict]:
    """For each wanted total weight a splitter {at, below, hot}: ``below`` is the exact weight of keys under ``at``.

    ``hot`` is the weight of the single key ``at``, if that alone exceeds the tolerance and holds the wanted weight.
    """
    low, high = rows.agg(F.min(key), F.max(key)).first()
    found: list[dict | None] = [None] * len(wanted)
    if low is None:
        return [{"at": 0, "below": 0, "hot": 0} for _ in wanted]
    spans = {(low, high + 1): (0, list(range(len(wanted))))}
    while spans:
        cases, where = [], list(spans)
        for n, (a, b) in enumerate(where):
            step = max(1, -(-(b - a) // PROBES))
            inside = (F.col(key) >= a) & (F.col(key) < b)
            cases.append((inside, F.struct(F.lit(n).alias("n"), F.expr(f"(`{key}` - {a}L) div {step}L").alias("i"))))
        counts: dict[int, dict[int, int]] = {n: {} for n in range(len(where))}
        for r in rows.select(_chained(cases).alias("s"), F.col(weight).alias("w")).where("s is not null").groupBy("s").agg(F.sum("w").alias("w")).collect():
            counts[r.s.n][r.s.i] = r.w
        deeper: dict[tuple[int, int], tuple[int, list[int]]] = {}
        for n, (a, b) in enumerate(where):
            below, want = spans[a, b]
            step = max(1, -(-(b - a) // PROBES))
            sums, total = [], below
            for i in range(-(-(b - a) // step)):
                sums.append((total, counts[n].get(i, 0), a + i * step))
                total += counts[n].get(i, 0)
            for k in want:
                under, own, at = next((s for s in sums if s[0] + s[1] > wanted[k]), (total, 0, b))
                if own <= tolerance or not own:
                    up = under + own - wanted[k] < wanted[k] - under
                    found[k] = {"at": min(b, at + step) if up else at, "below": under + own if up else under, "hot": 0}
                elif step == 1:
                    found[k] = {"at": at, "below": under, "hot": own}
                else:
                    deeper.setdefault((at, min(b, at + step)), (under, []))[1].append(k)
        spans = deeper
    return found


def sharded(rows: DataFrame, shards: int = 8, whole: DataFrame | None = None) -> DataFrame:
    """Written ``digests`` (or ``whole``, which has the same rows and columns and more) with (shard, slot): shards of near equal bytes
    in key order, slots without gaps. What is placed is exchanged once."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    wanted = [total * k / shards for k in range(1, shards)]
    tolerance = total * TOLERANCE / 1000 / shards
    above = []
    for k, s in enumerate(probed(rows, "key", "size", wanted, tolerance)):
        if s["hot"]:
            # a group of equal texts that is larger than the tolerance is cut between two ids
            own = rows.where(F.col("key") == s["at"]).select(F.coalesce("doc_id", F.lit(0)).alias("id"), "size")
            cut = probed(own, "id", "size", [wanted[k] - s["below"]], tolerance)[0]
            above.append((F.col("key") > s["at"]) | ((F.col("key") == s["at"]) & (F.coalesce("doc_id", F.lit(0)) >= cut["at"])))
        else:
            above.append(F.col("key") >= s["at"])
    shard = reduce(lambda a, b: a + b, (x.cast("int") for x in above)) if above and total else F.lit(0)
    def celled(df):
        return df.withColumn("shard", shard.cast("int")).withColumn("bin", F.shiftright("key", 62 - 12).cast("int"))

    cells = celled(rows)
    # slots: count by shard and bin, cut bins with many rows (copies of one text) by id, and number each piece on its own
    sizes = cells.groupBy("shard", "bin").agg(F.count("*").alias("n")).collect()
    most = 2 * max(16, -(-sum(r.n for r in sizes) // BINS))
    heavy = {(r.shard, r.bin): -(-r.n // most) for r in sizes if r.n > most}
    piece = F.lit(0)
    if heavy:
        cuts = F.create_map(*[F.lit(x) for (s, b), n in heavy.items() for x in (s * BINS + b, n)])
        piece = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.coalesce(cuts[F.col("shard") * BINS + F.col("bin")], F.lit(1)))
    cells, whole = (celled(x).withColumn("piece", piece.cast("int")) for x in (rows, rows if whole is None else whole))
    starts = cells.groupBy("shard", "bin", "piece").agg(F.count("*").alias("n"))
    by_shard = Window.partitionBy("shard").orderBy("bin", "piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("shard", "bin", "piece", F.coalesce(F.sum("n").over(by_shard), F.lit(0)).alias("start"))
    order = Window.partitionBy("shard", "bin", "piece").orderBy("key", "doc_id", "size")
    # at most shards * BINS pieces besides those of heavy bins, each of which holds rows: the table has a bound, and Spark checks its size
    return whole.withColumn("own", F.row_number().over(order) - 1).join(starts, ["shard", "bin", "piece"]).withColumn("slot", (F.col("start") + F.col("own")).cast("long"))


def write_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8) -> DataFrame:
    """Writes all rows of ``docs`` by shard, each file in slot order, and gives what was written: (shard, slot, row), ``row`` with all
    columns of ``docs``, whatever their names are.

    The splitters are found on digests; the rows themselves are exchanged once. The folder is below the shared one, and a lost
    executor only reruns tasks.
    """
    rows = written(digests(docs, id_col, text_col), "digests")
    whole = docs.select(*_digests(id_col, text_col), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return written(sharded(rows, shards, whole).select("shard", "slot", "row"), "shards", ["shard"])


def shards_by_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, key) of every row of ``docs``, from the shards that ``write_shards`` wrote.

    The law is ``bytes``: the shards' sizes differ by a few thousandths of a shard, or by one document where that is larger.
    Equal texts share a shard unless a boundary falls into a group that exceeds the tolerance. A null text counts as empty (one
    byte); rows without an id and repeated rows are sharded like others; an empty table gives no rows.
    """
    placed = write_shards(docs, id_col, text_col, shards)
    own = placed.select("shard", "slot", F.col(f"row.`{id_col}`").alias("id"), F.col(f"row.`{text_col}`").alias("text"))
    return own.select(*_digests("id", "text"), "shard", "slot").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "key")


class Ranges:
    """Sorted boundaries (key, tie) between ranges; a row belongs to the range after the last boundary that isn't above it."""

    def __init__(self, keys: list[int], ties: list[int]):
        self.keys, self.ties = np.array(keys, np.int64), np.array(ties, np.int64)

    def __len__(self) -> int:
        return len(self.keys) + 1

    def of(self, keys: np.ndarray, ties: np.ndarray) -> np.ndarray:
        first, last = (np.searchsorted(self.keys, keys, side=side) for side in ("left", "right"))
        out = last.copy()
        for k in np.flatnonzero(first < last):
            out[k] = first[k] + np.searchsorted(self.ties[first[k] : last[k]], ties[k], side="right")
        return out


#: Ranges that a table is cut into at most: boundaries go to every task, and every task of one stage sends to every range.
MOST_RANGES = 4096


def key_ranges(rows: DataFrame, key: str, tie: str, weight: str, target: int, most: int = MOST_RANGES) -> Ranges:
    """Boundaries that cut ``rows``, in the order of (key, tie), into ranges of ``target`` weight, or of more if that would be more than
    ``most`` ranges; the same for the same rows.

    Range k holds what begins between k and k + 1 times ``target`` of the running weight, so a range is larger by one (key, tie) at
    most, and a key with many rows is cut by ties. The running weight is exact: rows are dealt in sorted pieces, whose totals are added
    up first, so no task gets more than a piece, and where the pieces end doesn't matter. The driver holds two numbers for each piece
    and range.
    """
    sums = written(rows.groupBy(F.col(key).alias("k"), F.col(tie).alias("t")).agg(F.sum(weight).alias("w")), "sums")
    pieces = written(sums.repartitionByRange("k", "t").withColumn("piece", F.spark_partition_id()), "pieces")
    totals = sorted((r.piece, r.w) for r in pieces.groupBy("piece").agg(F.sum("w").alias("w")).collect())
    if not totals:
        return Ranges([], [])
    target = max(target, -(-sum(w for _, w in totals) // most))
    before = dict(zip((p for p, _ in totals), np.concatenate(([0], np.cumsum([w for _, w in totals])))[:-1].tolist(), strict=True))
    starts = pieces.sparkSession.createDataFrame(list(before.items()), "piece int, before long")
    own = Window.partitionBy("piece").orderBy("k", "t").rowsBetween(Window.unboundedPreceding, -1)
    begun = pieces.withColumn("sum", F.coalesce(F.sum("w").over(own), F.lit(0))).join(starts, "piece")
    firsts = begun.withColumn("range", F.expr(f"(sum + before) div {target}L")).groupBy("range").agg(F.min(F.struct("k", "t")).alias("at"))
    found = sorted((r["range"], r["at"].k, r["at"].t) for r in firsts.collect())[1:]
    return Ranges([k for _, k, _ in found], [t for _, _, t in found])
