"""Prediction metrics as aggregate expressions, all from one pass over (truth, prediction) rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

# fixed value: smallest denominator of the percentage error (machine epsilon of a double)
MAPE_FLOOR = 2.220446049250313e-16

# fixed values: accepted scoring names, the metric behind each and the sign that makes larger better
SCORING = {
    "r2": ("r2", 1.0),
    "MAPE": ("MAPE", -1.0),
    "neg_mean_absolute_percentage_error": ("MAPE", -1.0),
    "RMSE": ("RMSE", -1.0),
    "neg_root_mean_squared_error": ("RMSE", -1.0),
    "MAE": ("MAE", -1.0),
    "neg_mean_absolute_error": ("MAE", -1.0),
}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def both_present(y, p) -> tuple[Column, Column]:
    """Null out both sides unless both are there, so partial predictions do not bias a metric."""
    y, p = _c(y), _c(p)
    ok = y.isNotNull() & p.isNotNull()
    return F.when(ok, y), F.when(ok, p)


def r2(y, p) -> Column:
    y, p = both_present(y, p)
    return F.when(F.var_pop(y) > 0, 1 - F.avg((y - p) * (y - p)) / F.var_pop(y))


def rmse(y, p) -> Column:
    y, p = both_present(y, p)
    return F.sqrt(F.avg((y - p) * (y - p)))


def rmse_over_std(y, p) -> Column:
    y2, _ = both_present(y, p)
    return F.when(F.var_pop(y2) > 0, rmse(y, p) / F.stddev_pop(y2))


def mape(y, p) -> Column:
    y, p = both_present(y, p)
    return F.avg(F.abs(y - p) / F.greatest(F.abs(y), F.lit(MAPE_FLOOR)))


def mae(y, p) -> Column:
    y, p = both_present(y, p)
    return F.avg(F.abs(y - p))


def rae(y, p, y_mean) -> Column:
    """Relative absolute error; ``y_mean`` is the group's mean of the truth, joined or carried in."""
    y, p = both_present(y, p)
    return F.sum(F.abs(p - y)) / F.sum(F.abs(_c(y_mean) - y))


def f1(y, p) -> Column:
    """Binary f1 of labels 0/1 from the three counts it needs."""
    y, p = _c(y), _c(p)
    tp = F.sum(((y == 1) & (p == 1)).cast("long"))
    wrong = F.sum((y != p).cast("long"))
    return F.when(2 * tp + wrong > 0, 2.0 * tp / (2 * tp + wrong)).otherwise(0.0)


def log_loss(y, prob, floor: float = MAPE_FLOOR) -> Column:
    """Mean of -ln of the probability given to the true label; ``prob`` is P(label = 1)."""
    y, prob = _c(y), _c(prob)
    q = F.when(y == 1, prob).otherwise(1 - prob)
    return F.avg(-F.ln(F.least(F.greatest(q, F.lit(floor)), F.lit(1 - floor))))


def f1_classes(y, p, classes: list[float], average: str = "macro") -> Column:
    """f1 over any number of classes: the mean over them, their mean by rows (weighted), or from all counts together (micro).

    Classes that neither side holds are left out.
    """
    y, p = _c(y), _c(p)
    parts = []
    for k in classes:
        yes, said = y == F.lit(float(k)), p == F.lit(float(k))
        parts.append((F.sum((yes & said).cast("long")), F.sum(yes.cast("long")), F.sum(said.cast("long"))))
    if average == "micro":
        tp, both = sum((t for t, _, _ in parts), F.lit(0)), sum((a + b for _, a, b in parts), F.lit(0))
        return F.when(both > 0, 2.0 * tp / both).otherwise(0.0)
    if average not in ("macro", "weighted"):
        raise ValueError(f"unknown average {average!r}; known: macro, weighted, micro")
    one = [F.when(a + b > 0, 2.0 * t / (a + b)).otherwise(0.0) for t, a, b in parts]
    weight = [F.when(a + b > 0, a if average == "weighted" else F.lit(1)).otherwise(0) for _, a, b in parts]
    total = sum(weight, F.lit(0))
    return F.when(total > 0, sum((o * w for o, w in zip(one, weight)), F.lit(0.0)) / total).otherwise(0.0)


def log_loss_given(prob, floor: float = MAPE_FLOOR) -> Column:
    """Mean of -ln of ``prob``, the probability given to the true one of any number of classes."""
    return F.avg(-F.ln(F.least(F.greatest(_c(prob), F.lit(floor)), F.lit(1 - floor))))


METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "r2": r2, "RMSE": rmse, "RMSE/std": rmse_over_std, "MAPE": mape, "MAE": mae,
}


def score(name: str, y, p) -> Column:
    """Signed score of a scoring name: larger is better for each of them."""
    metric, sign = SCORING[name]
    return sign * METRICS[metric](y, p)


def resolve_scorer(scorer: str | Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    """A scoring name, or a callable ``(y, p) -> aggregate Column``."""
    if callable(scorer):
        return scorer
    if scorer not in SCORING:
        raise ValueError(f"unknown scoring {scorer!r}; known: {sorted(SCORING)}")
    return lambda y, p: score(scorer, y, p)


def weighted_score(train, test, classification: bool = False) -> Column:
    """Loss of a train/test score pair: the gap counts, and so does a poor test score."""
    train, test = _c(train), _c(test)
    gap = F.abs(train - test)
    return gap + 4 * (1 - test) if classification else 4 * gap + test


def harmonic_score(train, test) -> Column:
    """Twice the rounded product over sum of a train/test score pair."""
    train, test = _c(train), _c(test)
    return F.bround(train * test / (train + test), 2) * 2


def regression_metrics(rows: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """r2, RMSE, RMSE/std, MAPE, MAE and rae per group.

    The group mean that rae needs comes from a first aggregate joined back: one row per group, so no
    data row is shuffled for it.
    """
    means = rows.groupBy(*by).agg(F.avg(both_present(y, p)[0]).alias("__y_mean"))
    joined = rows.join(means, by) if by else rows.withColumn("__y_mean", F.lit(means.first()[0]))
    return joined.groupBy(*by).agg(
        *[fn(F.col(y), F.col(p)).alias(name) for name, fn in METRICS.items()],
        rae(y, p, "__y_mean").alias("rae"),
    )
