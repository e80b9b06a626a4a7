"""Agreement between an oracle and an extraction: matching, verdicts, bounds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Verdicts from the worst to the best.
VERDICTS = ("wrong", "missed", "extra", "agree")


def paired(oracle: DataFrame, found: DataFrame, key: list[str], order: str) -> DataFrame:
    """J35 (exact pass) and J37: one-to-one pairs, in order within equal keys; the rest of either side stays single."""
    w = Window.partitionBy(*key).orderBy(order)
    a = oracle.select(*key, F.col(order).alias("oracle_id"), F.row_number().over(w).alias("rn"))
    b = found.select(*key, F.col(order).alias("found_id"), F.row_number().over(w).alias("rn"))
    return a.join(b, [*key, "rn"], "full").select(*key, "rn", "oracle_id", "found_id")


def worst_verdict(pairs: DataFrame, by: list[str], verdict: str) -> DataFrame:
    """A pair's verdict is the worst of its parts'."""
    names = F.array(*[F.lit(v) for v in VERDICTS])
    return pairs.groupBy(*by).agg(F.min(F.array_position(names, F.col(verdict))).alias("_ord")).select(*by, F.element_at(names, F.col("_ord").cast("int")).alias("verdict"))


def strata(scores: DataFrame, stratum: str, verdict: str) -> DataFrame:
    """Per stratum the count of every verdict, zeros included."""
    cells = [F.count_if(F.col(verdict) == v).alias(f"n_{v}") for v in VERDICTS]
    return scores.groupBy(stratum).agg(F.count("*").alias("n"), *cells)


def _beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function by its continued fraction, on the side where that is short."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    tail = 1.0
    for m in range(200, 0, -1):  # from the innermost term outwards
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        tail = 1 + even / (1 + odd / tail)
    return front / (1 - (a + b) * x / ((a + 1) * tail))


def upper_bound(errors: int, n: int, level: float = 0.95) -> float | None:
    """The one-sided exact binomial upper bound of an error rate, NULL of nothing.

    It is the ``level`` quantile of a beta distribution with errors + 1 and n - errors, found by
    Newton's steps on its distribution, kept within the bracket that they narrow.
    """
    if n <= 0:
        return None
    if errors >= n:
        return 1.0
    a, b = errors + 1.0, float(n - errors)
    scale = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    low, high, x = 0.0, 1.0, a / (a + b)
    for _ in range(100):
        miss = _beta_share(a, b, x) - level
        low, high = (low, x) if miss > 0 else (x, high)
        density = math.exp(scale + (a - 1) * math.log(x) + (b - 1) * math.log1p(-x))
        step = x - miss / density if density > 0 else low
        new = step if low < step < high else (low + high) / 2
        if abs(new - x) < 1e-13:
            break
        x = new
    return new


def with_bounds(counts: DataFrame, errors: str, n: str) -> DataFrame:
    """F16 on rows of counts; a stratum is one row, so the Python work is small."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(bound=[upper_bound(int(e), int(m)) for e, m in zip(pdf[errors], pdf[n], strict=True)])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counts.schema)
    return counts.mapInPandas(run, f"{schema}, bound double")
