"""Statistics over grouped counts: window and aggregate forms on Spark, and small numeric functions for one series at a time."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ravelin.operators.numeric import chi2_tail, poisson_interval  # noqa: F401
from ravelin.operators.ordered import placed, with_totals


#: Largest groups whose share is told.
LARGEST = (1, 3, 5, 10)


def concentration(groups: DataFrame, key: str, value: str) -> DataFrame:
    """One row: Herfindahl index, Gini coefficient, shares of the largest 1, 3, 5 and 10, effective number of groups; all null if nothing
    has a value."""
    own = with_totals(groups.select(key, value), all=F.sum(value), n=F.count("*"))
    s = placed(own, [F.asc(value), F.asc(key)], name="i").withColumn("s", F.try_divide(value, "all"))
    squares = F.sum(F.col("s") * F.col("s"))
    return s.agg(
        F.round(squares, 6).alias("hhi"),
        F.round(F.sum((2 * F.col("i") - F.col("n") - 1) * F.col("s")) / F.max("n"), 6).alias("gini"),
        *[F.round(F.sum(F.when(F.col("i") > F.col("n") - k, F.col("s"))), 6).alias(f"cr{k}") for k in LARGEST],
        F.round(F.try_divide(F.lit(1.0), squares), 6).alias("effective"),
    )


def homogeneity(groups: DataFrame, key: str, hits: str, total: str) -> DataFrame:
    """(key, expected, residual, chi2): adjusted residuals of a 2 x K table, and its chi-square on every line; what one group, no hits or
    nothing but hits can't say is null."""
    own = with_totals(groups, p=F.try_divide(F.sum(hits), F.sum(total)), all=F.sum(total))
    own = own.withColumn("expected", F.col(total) * F.col("p"))
    own = own.withColumn("d", F.col(hits) - F.col("expected")).withColumn("residual", F.try_divide("d", F.sqrt(F.col("expected") * (1 - F.col("p")) * (1 - F.try_divide(total, "all")))))
    own = with_totals(own, chi2=F.sum(F.try_divide(F.col("d") * F.col("d"), F.col("expected") * (1 - F.col("p")))))
    return own.select(key, F.round("expected", 6).alias("expected"), F.round("residual", 6).alias("residual"), F.round("chi2", 6).alias("chi2"))


def chart(series: DataFrame, at: str, count: str, exposure: str, kind: str = "u", baseline: Column | None = None, open_: Column | None = None) -> DataFrame:
    """(at, rate, center, sigma_z, z, low, high, out): control chart whose limits are widened by the spread of the standardised points.

    ``kind`` is u (counts by exposure), c (counts of equal exposures) or p (shares, which end at 1). The centre and the spread come from
    the points of ``baseline`` (all, if not given) that have an exposure. Points that are still ``open_`` and those without an exposure
    take part in nothing and have no z and no limits; nor has any point of a series without counts. A series is bounded by its calendar.
    """
    order = Window.orderBy(at)
    size = F.lit(1.0) if kind == "c" else F.col(exposure)
    own = series.withColumn("_n", F.when(F.col(exposure) > 0, size))
    own = own.withColumn("_use", F.col("_n").isNotNull() & ~(F.lit(False) if open_ is None else F.coalesce(open_, F.lit(False))))
    own = own.withColumn("_b", (F.lit(True) if baseline is None else baseline) & F.col("_use"))
    own = with_totals(own, center=F.try_divide(F.sum(F.when(F.col("_b"), F.col(count))), F.sum(F.when(F.col("_b"), F.col("_n")))))
    spread = F.col("center") * (1 - F.col("center")) if kind == "p" else F.col("center")
    sigma = F.nullif(F.sqrt(F.try_divide(spread, F.when(F.col("_use"), F.col("_n")))), F.lit(0.0))
    own = own.withColumn("rate", F.try_divide(F.col(count), "_n")).withColumn("sigma", sigma).withColumn("raw", F.try_divide(F.col("rate") - F.col("center"), "sigma"))
    # moving ranges go from one baseline point to the next
    based = own.where("_b").withColumn("moved", F.abs(F.col("raw") - F.lag("raw").over(order)))
    own = own.crossJoin(F.broadcast(based.agg(F.greatest(F.coalesce(F.avg("moved") / 1.128, F.lit(1.0)), F.lit(1.0)).alias("sigma_z"))))
    half = 3 * F.col("sigma") * F.col("sigma_z")
    low, high = F.when(half.isNotNull(), F.greatest(F.col("center") - half, F.lit(0.0))), F.col("center") + half
    high = F.when(half.isNotNull(), F.least(high, F.lit(1.0))) if kind == "p" else high
    own = own.withColumns({"low": low, "high": high, "z": F.col("raw") / F.col("sigma_z")})
    out = F.coalesce((F.col("rate") < F.col("low")) | (F.col("rate") > F.col("high")), F.lit(False))
    return own.select(at, *[F.round(n, 6).alias(n) for n in ("rate", "center", "sigma_z", "z", "low", "high")], out.alias("out"))


def runs(points: DataFrame, at: str, z: str, rate: str) -> DataFrame:
    """(at, z, beyond, same_side, trend, two_of_three): four run rules over fixed frames; trends are those of the rates.

    A point without z or rate isn't there for a rule: runs go on behind it, and it has no signal.
    """
    order = Window.orderBy(at)
    side = lambda n: Window.orderBy(at).rowsBetween(1 - n, 0)
    full = lambda n: F.count(z).over(side(n)) == n
    own = points.where(F.col(z).isNotNull() & F.col(rate).isNotNull())
    own = own.withColumn("up", (F.col(rate) > F.lag(rate).over(order)).cast("int")).withColumn("down", (F.col(rate) < F.lag(rate).over(order)).cast("int"))
    found = own.select(
        F.col(at).alias("_at"),
        (F.abs(z) > 3).alias("beyond"),
        (full(9) & ((F.min(z).over(side(9)) > 0) | (F.max(z).over(side(9)) < 0))).alias("same_side"),
        (full(6) & ((F.sum("up").over(side(5)) == 5) | (F.sum("down").over(side(5)) == 5))).alias("trend"),
        (full(3) & (((F.sum((F.col(z) > 2).cast("int")).over(side(3)) >= 2) & (F.col(z) > 2)) | ((F.sum((F.col(z) < -2).cast("int")).over(side(3)) >= 2) & (F.col(z) < -2)))).alias("two_of_three"),
    )
    return points.join(found, F.col(at) == F.col("_at"), "left").select(at, z, *[F.coalesce(n, F.lit(False)).alias(n) for n in ("beyond", "same_side", "trend", "two_of_three")])


def adjusted(tests: DataFrame, key: str, p: str) -> DataFrame:
    """(key, p, q): Benjamini-Hochberg q values, the smallest p n / rank from a test on."""
    own = with_totals(tests.select(key, p), _n=F.count("*"))
    out = placed(own, [F.asc(p), F.asc(key)], least={"q": F.col(p) * F.col("_n") / F.col("rank")})
    return out.select(key, p, F.least("q", F.lit(1.0)).alias("q"))


def _deviance(counts: np.ndarray, expected: np.ndarray) -> float:
    some = counts > 0
    logs = np.zeros(len(counts))
    logs[some] = counts[some] * np.log(counts[some] / np.maximum(expected[some], 1e-300))
    return float(2 * (logs - (counts - expected)).sum())


def changes(counts: np.ndarray, exposures: np.ndarray, penalty: float, least: int = 3, phi: float = 1.0) -> list[int]:
    """First points of the segments of a Poisson series whose deviance over the dispersion ``phi``, plus a penalty for each change, is
    smallest (exact dynamic programme); of equal ones that with the earliest starts."""
    n = len(counts)
    c, e = np.concatenate(([0.0], np.cumsum(counts))), np.concatenate(([0.0], np.cumsum(exposures)))

    best, last = np.full(n + 1, math.inf), [0] * (n + 1)
    best[0] = 0.0
    changed = np.full(n + 1, penalty)
    changed[0] = 0.0
    for j in range(least, n + 1):
        ends = j - least + 1
        k, x = c[j] - c[:ends], e[j] - e[:ends]
        some = (k > 0) & (x > 0)
        cost = np.zeros(ends)
        cost[some] = -2 * k[some] * np.log(k[some] / x[some]) / phi
        now = math.inf
        for i, value in enumerate((best[:ends] + cost + changed[:ends]).tolist()):
            if value < now - 1e-9:
                now, last[j] = value, i
        best[j] = now
    out, j = [], n
    while j > 0 and best[j] < math.inf:
        j = last[j]
        if j:
            out.append(j)
    return out[::-1]


def levelled(counts: np.ndarray, exposures: np.ndarray, starts: list[int]) -> np.ndarray:
    """Expected counts where each segment has the rate of its sums."""
    edges = [0, *starts, len(counts)]
    rate = np.concatenate([np.full(b - a, counts[a:b].sum() / max(exposures[a:b].sum(), 1e-300)) for a, b in zip(edges, edges[1:])]) if len(counts) else np.zeros(0)
    return rate * exposures


def over_dispersion(counts: np.ndarray, expected: np.ndarray, parameters: int) -> float:
    """How much wider than Poisson a series scatters, 1 at least: the larger of two measures of its standardised residuals.

    The median of their steps (a change of level touches one step only) is short of the mark in short series; the sum of squares over
    the degrees of freedom isn't, but grows with levels that were missed.
    """
    some = expected > 0
    z = (counts[some] - expected[some]) / np.sqrt(expected[some])
    steps = np.diff(z)
    by_steps = (1.4826 * float(np.median(np.abs(steps - np.median(steps))))) ** 2 / 2 if len(z) >= 3 else 1.0
    free = len(z) - parameters
    return max(1.0, by_steps, float((z * z).sum()) / free if free >= 1 else 1.0)


def searched(value, start: np.ndarray, rounds: int = 400) -> tuple[np.ndarray, float]:
    """(point, value) where a function of a few parameters is smallest: a simplex that is reflected, stretched or drawn in."""
    points = [start] + [start + step for step in np.diag(np.full(len(start), 0.5))]
    scores = [value(x) for x in points]
    for _ in range(rounds):
        order = np.argsort(scores, kind="stable")
        points, scores = [points[i] for i in order], [scores[i] for i in order]
        if scores[-1] - scores[0] < 1e-10:
            break
        mid = np.mean(points[:-1], axis=0)
        tried = [(s := value(x := mid + f * (points[-1] - mid)), x) for f in (-1.0, -2.0, 0.5)]
        ahead, far, inner = tried
        best = min(ahead, far, key=lambda t: t[0]) if ahead[0] < scores[-2] else inner
        if best[0] < scores[-1]:
            scores[-1], points[-1] = best
        else:
            points = [points[0]] + [(points[0] + x) / 2 for x in points[1:]]
            scores = [scores[0]] + [value(x) for x in points[1:]]
    k = int(np.argmin(scores))
    return points[k], scores[k]


def weibull(units: np.ndarray, horizon: np.ndarray, fails: list[np.ndarray]) -> tuple[float, float]:
    """(shape, scale) by maximum likelihood from cohorts that begin at one time: units at risk, ages observed, failures at ages 0, 1, ..."""

    def minus_log(theta: np.ndarray) -> float:
        shape, scale = np.exp(theta)
        out = 0.0
        for n, h, f in zip(units, horizon, fails, strict=True):
            reached = -np.expm1(-((np.arange(int(h) + 1) / scale) ** shape))
            share = np.clip(np.diff(reached), 1e-300, None)
            out -= float((f[: len(share)] * np.log(share)).sum()) + (n - f[: len(share)].sum()) * math.log(max(1 - reached[-1], 1e-300))
        return out

    (shape, scale), _ = searched(minus_log, np.array([0.0, 3.0]))
    return math.exp(shape), math.exp(scale)


class Life:
    """A Weibull life fitted to failures by age: of all units, or of a share of them that can fail at all (``defective``).

    Within a cohort units begin evenly over a period, so a unit has reached age a in period a with the mean of the distribution over
    the period. ``failures[a]`` are counts by age, ``horizons`` the last age seen of each cohort and ``left`` its units without a failure.
    """

    def __init__(self, failures: np.ndarray, horizons: np.ndarray, left: np.ndarray, defective: bool):
        self.failures, self.horizons, self.left, self.defective = failures, horizons, left, defective
        mean = (failures * np.arange(1, len(failures) + 1)).sum() / max(failures.sum(), 1)
        start = np.array([0.0, math.log(max(2 * mean, 1.0))] + ([0.0] if defective else []))
        self.theta, loss = searched(self._loss, start)
        self.log_likelihood = -loss

    @staticmethod
    def unpacked(theta: np.ndarray) -> tuple[float, float, float]:
        """(shape, scale, share that can fail)"""
        return math.exp(min(theta[0], 5)), math.exp(min(theta[1], 30)), 1 / (1 + math.exp(-theta[2])) if len(theta) > 2 else 1.0

    @staticmethod
    def cumulative(ages: np.ndarray, theta: np.ndarray) -> np.ndarray:
        """Failed share of a cohort at the end of each age, by the midpoint rule on 16 parts of a period."""
        shape, scale, share = Life.unpacked(theta)
        inside = (np.arange(16) + 0.5) / 16
        return share * -np.expm1(-(((ages[:, None] + inside) / scale) ** shape)).mean(axis=1)

    def _loss(self, theta: np.ndarray) -> float:
        failed = np.diff(self.cumulative(np.arange(len(self.failures), dtype=float), theta), prepend=0.0)
        stay = 1 - self.cumulative(self.horizons.astype(float), theta)
        return -float((self.failures * np.log(np.maximum(failed, 1e-300))).sum() + (self.left * np.log(np.maximum(stay, 1e-300))).sum())

    def life(self, share: float, theta: np.ndarray | None = None) -> float | None:
        """The age at which ``share`` of the units has failed; none, if it never does."""
        shape, scale, most = self.unpacked(self.theta if theta is None else theta)
        return scale * (-math.log1p(-share / most)) ** (1 / shape) if share < most else None

    def covariance(self) -> np.ndarray | None:
        """Of the parameters, from the curvature of the likelihood; none where it isn't bent in all directions."""
        k, step = len(self.theta), 1e-3
        at = lambda *moves: self._loss(self.theta + sum(step * sign * np.eye(k)[i] for i, sign in moves))
        bend = np.array([[(at((i, 1), (j, 1)) - at((i, 1), (j, -1)) - at((i, -1), (j, 1)) + at((i, -1), (j, -1))) / (4 * step * step) for j in range(k)] for i in range(k)])
        values = np.linalg.eigvalsh(bend)
        return np.linalg.inv(bend) if values[0] > 1e-10 * values[-1] else None

    def life_interval(self, share: float, width: float = 1.959964) -> tuple[float, float] | None:
        """Of ``life``, by the slopes of its logarithm."""
        middle, spread = self.life(share), self.covariance()
        if middle is None or spread is None:
            return None
        slopes = []
        for step in np.eye(len(self.theta)) * 1e-4:
            up, down = self.life(share, self.theta + step), self.life(share, self.theta - step)
            if up is None or down is None:
                return None
            slopes.append((math.log(up) - math.log(down)) / 2e-4)
        half = width * math.sqrt(max(float(np.array(slopes) @ spread @ np.array(slopes)), 0.0))
        return middle * math.exp(-half), middle * math.exp(half)


def best_life(failures: np.ndarray, horizons: np.ndarray, left: np.ndarray) -> tuple[Life, float]:
    """(life, p): the defective model where its likelihood is larger by more than chance gives (5 %; the share is at its bound), else the plain one."""
    plain, other = (Life(failures, horizons, left, x) for x in (False, True))
    p = chi2_tail(max(2 * (other.log_likelihood - plain.log_likelihood), 0.0), 1) / 2
    return (other if p < 0.05 else plain), p


def season_index(counts: np.ndarray, expected: np.ndarray, season: np.ndarray, length: int) -> np.ndarray:
    """Ratio of each season to the level: medians of the logarithms of counts to what the level expects, with mean 0."""
    ratio = np.log((counts + 0.5) / (expected + 0.5))
    index = np.array([np.median(ratio[season == s]) if (season == s).any() else 0.0 for s in range(length)])
    return np.exp(index - index.mean())


def moving_level(counts: np.ndarray, exposures: np.ndarray, width: int) -> np.ndarray:
    """Median rate of the ``width`` points around each; at the ends the frame is moved inwards."""
    rate = np.divide(counts, exposures, out=np.zeros(len(counts)), where=exposures > 0)
    width = min(width, len(rate))
    first = np.clip(np.arange(len(rate)) - width // 2, 0, len(rate) - width)
    return np.median(np.lib.stride_tricks.sliding_window_view(rate, width)[first], axis=1) if width else rate


def _in_turn(counts: np.ndarray, exposures: np.ndarray, season: np.ndarray, index: np.ndarray, seasonal: bool, penalty: float, rounds: int) -> tuple[list[int], np.ndarray, float]:
    """(starts, index, phi): dispersion, segments and seasons in turn, each with the others as they are, until the segments stay."""
    starts: list[int] = []
    before, phi = None, 1.0
    for _ in range(rounds):
        x = exposures * index[season]
        phi = over_dispersion(counts, levelled(counts, x, starts), 1 + len(starts) + (len(index) - 1) * seasonal)
        starts = changes(counts, x, penalty, phi=phi)
        if seasonal:
            index = season_index(counts, levelled(counts, x, starts) / index[season], season, len(index))
        if starts == before:
            break
        before = starts
    return starts, index, phi


def seasonal_changes(counts: np.ndarray, exposures: np.ndarray, season: np.ndarray, length: int, penalty: float, rounds: int = 10) -> tuple[list[int], np.ndarray, float]:
    """(first points of the segments, season index, phi) of a Poisson series with seasons and over-dispersion.

    The seasons begin from a moving level (good for a step within a year) and from one level for all (good for one at its edge); of the two
    ends the one with the smaller penalised deviance counts, both measured by the larger dispersion. Series of less than two years have
    no seasons.
    """
    if not len(counts) or length < 2 or len(counts) < 2 * length:
        return _in_turn(counts, exposures, season, np.ones(max(length, 1)), False, penalty, rounds)
    begins = (moving_level(counts, exposures, length + 1) * exposures, levelled(counts, exposures, []))
    found = [_in_turn(counts, exposures, season, season_index(counts, level, season, length), True, penalty, rounds) for level in begins]
    phi = max(f[2] for f in found)

    def objective(one: tuple[list[int], np.ndarray, float]) -> float:
        return _deviance(counts, levelled(counts, exposures * one[1][season], one[0])) / phi + penalty * len(one[0])

    return min(found, key=objective)


def linked_groups(shapes: np.ndarray, most: int = 10) -> tuple[np.ndarray, float]:
    """(group of each row, silhouette): rows joined by average distance of cosines, cut where the silhouette is best."""
    size = np.linalg.norm(shapes, axis=1, keepdims=True)
    unit = shapes / np.where(size > 0, size, 1)
    apart = np.clip(1 - unit @ unit.T, 0, None)
    np.fill_diagonal(apart, 0)
    n = len(apart)
    member = np.eye(n, dtype=bool)
    best = (np.zeros(n, np.int64), -1.0)
    while len(member) > 2:
        sizes = member.sum(axis=1)
        mean = member @ apart @ member.T / np.outer(sizes, sizes)
        np.fill_diagonal(mean, np.inf)
        a, b = sorted(divmod(int(mean.argmin()), len(mean)))
        member[a] |= member[b]
        member = np.delete(member, b, axis=0)
        if len(member) <= min(most, n - 1):
            group = member.argmax(axis=0)
            sums = apart @ member.T
            sizes = member.sum(axis=1)
            own = sums[np.arange(n), group] / np.maximum(sizes[group] - 1, 1)
            others = np.where(np.arange(len(member)) == group[:, None], np.inf, sums / sizes).min(axis=1)
            score = float(np.where(sizes[group] > 1, (others - own) / np.maximum(np.maximum(own, others), 1e-300), 0).mean())
            if score >= best[1]:
                best = group, score
    return best


def ppmi(table: np.ndarray) -> np.ndarray:
    """Positive pointwise mutual information of a table of counts."""
    total = table.sum()
    expected = np.outer(table.sum(axis=1), table.sum(axis=0)) / max(total, 1)
    return np.maximum(np.log(np.where((table > 0) & (expected > 0), table / np.maximum(expected, 1e-300), 1.0)), 0)
