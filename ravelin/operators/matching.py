"""Matching of what is written with what is there: ladders of equi-joins whose first rung that finds something decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.functions.texts import word_grams

#: Characters behind which a key may be cut to its front.
BOUNDARIES = "[_ -]"


def ladder(asked: DataFrame, ident: str, rungs: list[tuple[str, DataFrame, Column, str]], target: str) -> DataFrame:
    """(ident, target, how) of every row of ``asked``: by the first rung that finds one, and only one, target.

    A rung is its name, a table (``_k``, target), the column of ``asked`` that is looked up, and what happens if several are found: ``stop``
    (nothing is chosen: how is several) or ``least`` (the smallest is). Rungs are joins of equal keys; what they find is one row for
    each asked row and rung before it is compared.
    """
    found = None
    for step, (_, table, key, several) in enumerate(rungs):
        own = asked.select(F.col(ident), key.alias("_k")).where("_k is not null").join(table.select("_k", target).distinct(), "_k")
        own = own.groupBy(ident).agg(F.countDistinct(target).alias("_n"), F.min(target).alias(target)).select(ident, F.lit(step).alias("_step"), F.lit(several == "stop").alias("_stop"), "_n", target)
        found = own if found is None else found.union(own)
    best = found.groupBy(F.col(ident).alias("_id")).agg(F.min_by(F.struct("_step", "_stop", "_n", target), "_step").alias("_b"))
    out = asked.join(best, F.col(ident) == F.col("_id"), "left")
    clash = F.col("_b._stop") & (F.col("_b._n") > 1)
    names = F.array(*[F.lit(r[0]) for r in rungs])
    how = F.when(F.col("_b").isNull(), "none").when(clash, "several").otherwise(F.try_element_at(names, F.col("_b._step") + 1))
    return out.select(ident, F.when(~clash, F.col(f"_b.{target}")).alias(target), how.alias("how"))


def key_match(asked: DataFrame, ident: str, text: str, keys: DataFrame, key: str) -> DataFrame:
    """(ident, found, how): the key that a text stands for: exactly, in another case, or as the only one that begins so at a boundary."""
    own = keys.select(F.col(key).alias("found")).distinct()
    cuts = F.filter(F.sequence(F.lit(2), F.greatest(F.length("found"), F.lit(2))), lambda i: F.substr("found", i, F.lit(1)).rlike(BOUNDARIES))
    fronts = own.select("found", F.explode(F.transform(cuts, lambda i: F.upper(F.substr("found", F.lit(1), i - 1)))).alias("_k"))
    asked_ = F.col(text)
    rungs = [("exact", own.withColumn("_k", F.col("found")), asked_, "stop"), ("case", own.withColumn("_k", F.upper("found")), F.upper(asked_), "stop"), ("prefix", fronts, F.upper(asked_), "stop")]
    return ladder(asked, ident, rungs, "found")


def _fronts(text: Column) -> Column:
    """The first three letters of a text, or all of a shorter one."""
    return F.substring(text, 1, 3)


def containing(asked: DataFrame, ident: str, text: str, labels: DataFrame, label: str) -> DataFrame:
    """(ident, label): distinct labels that contain a text. What begins a text stands somewhere in such a label, so pairs come from equal
    pieces of one to three letters."""
    some = F.flatten(F.transform(F.sequence(F.lit(1), F.length(label)), lambda i: F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.substr(F.col(label), i, n))))
    own = labels.select(label).where(F.length(label) > 0).distinct().select(label, F.explode(F.array_distinct(some)).alias("_k"))
    want = asked.select(ident, F.col(text).alias("_t")).where("_t <> ''").withColumn("_k", _fronts(F.col("_t")))
    return own.join(want, "_k").where(F.contains(F.col(label), F.col("_t"))).select(ident, label)


def _thinned(text: Column) -> Column:
    """The text, and it without any one or two of its letters."""
    without = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(F.substr(x, F.lit(1), i - 1), F.substr(x, i + 1, F.length(x))))
    one = without(text)
    return F.array_distinct(F.concat(F.array(text), one, F.flatten(F.transform(one, without))))


def misspelled(asked: DataFrame, ident: str, text: str, labels: DataFrame, label: str) -> DataFrame:
    """(ident, label): distinct labels within two edits of a text. Two texts so near meet when two letters at most are left out of each, so
    pairs come from equal thinned texts."""
    own = labels.select(label).where(F.col(label).isNotNull()).distinct().select(label, F.explode(_thinned(F.col(label))).alias("_k"))
    want = asked.select(ident, F.col(text).alias("_t")).where("_t is not null").select(ident, "_t", F.explode(_thinned(F.col("_t"))).alias("_k"))
    return own.join(want, "_k").where(F.levenshtein(F.col(label), F.col("_t")) <= 2).select(ident, label).distinct()


def word_similarity(asked: Column, ordered: Column) -> Column:
    """The best similarity of a set of pieces with the pieces of a run of ``ordered``: shared ones over those of either.

    A best run begins and ends with a shared piece, so only such runs are tried.
    """
    shared = F.filter(F.transform(ordered, lambda g, i: F.when(F.array_contains(asked, g), i + 1)), lambda i: i.isNotNull())

    def of(run: Column) -> Column:
        both = F.size(F.array_intersect(run, asked))
        return both / (F.size(asked) + F.size(F.array_distinct(run)) - both)

    best = F.transform(shared, lambda a: F.array_max(F.transform(F.filter(shared, lambda b: b >= a), lambda b: of(F.slice(ordered, a, b - a + 1)))))
    return F.coalesce(F.array_max(best), F.lit(0.0))


def near_names(asked: DataFrame, ident: str, text: str, names: DataFrame, name: str, floor: float) -> DataFrame:
    """(ident, name, similarity): names near a text by their three-letter pieces, ``floor`` at least: the larger of the shared share of all
    pieces and ``word_similarity``, which finds a text within a longer name.

    Either is at most the share of the text's pieces that a name has, so pairs come from shared pieces (an equi-join) and only those with
    enough of them are compared. Repeated names count once.
    """
    own = names.select(F.col(name), word_grams(F.col(name), 3).alias("_o")).distinct()
    want = asked.select(F.col(ident), F.array_distinct(word_grams(F.col(text), 3)).alias("_q"))
    pairs = own.select(name, F.explode(F.array_distinct("_o")).alias("_p")).join(want.select(ident, F.size("_q").alias("_m"), F.explode("_q").alias("_p")), "_p")
    pairs = pairs.groupBy(ident, name, "_m").agg(F.count("*").alias("_k")).where(F.col("_k") >= floor * F.col("_m")).select(ident, name, "_k")
    both = pairs.join(own, name).join(want, ident)
    whole = F.col("_k") / (F.size("_q") + F.size(F.array_distinct("_o")) - F.col("_k"))
    out = both.select(ident, name, F.greatest(whole, word_similarity(F.col("_q"), F.col("_o"))).alias("similarity"))
    return out.where(F.col("similarity") >= floor)
