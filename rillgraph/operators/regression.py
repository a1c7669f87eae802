"""Least squares with the sums made by Spark in one aggregate and the small system solved on the driver."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _moments(rows: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows without nulls, means, population covariances."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    own = rows.select(*(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns))).dropna()
    r = own.agg(F.count(F.lit(1)), *(F.avg(f"c{i}") for i in range(len(columns))), *(F.covar_pop(f"c{i}", f"c{j}") for i, j in pairs)).first()
    cov = np.zeros((len(columns),) * 2)
    for (i, j), v in zip(pairs, r[1 + len(columns) :]):
        cov[i, j] = cov[j, i] = v or 0.0
    return r[0], np.array([x or 0.0 for x in r[1 : 1 + len(columns)]]), cov


def ridge(rows: DataFrame, features: list[str], target: str, alpha: float = 1e-6) -> dict:
    """Coefficients of standardised features (constant ones have scale 1), the intercept and R² (None below two rows)."""
    n, mean, cov = _moments(rows, [*features, target])
    if n < 2 or not features:
        return {"samples": n, "features": features, "r2": None}
    scale = np.sqrt(np.diag(cov))[:-1]
    scale[scale == 0] = 1.0
    gram, right = n * cov[:-1, :-1] / np.outer(scale, scale), n * cov[:-1, -1] / scale
    beta = np.linalg.solve(gram + alpha * np.eye(len(features)), right)
    total = n * cov[-1, -1]
    left = total - 2 * beta @ right + beta @ gram @ beta
    return {"samples": n, "features": features, "r2": 1 - left / total if total else None, "intercept": float(mean[-1]), "coefficients": dict(zip(features, beta.tolist()))}


def _products(rows: DataFrame, columns: list[str], weight) -> tuple[np.ndarray, np.ndarray]:
    """Sums of weighted products: columns by columns; the last is the target."""
    n, cov = len(columns), np.zeros((len(columns),) * 2)
    own = rows.select(*(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)), weight.alias("w")).dropna()
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    for (i, j), v in zip(pairs, own.agg(*(F.sum(F.col("w") * F.col(f"c{i}") * F.col(f"c{j}")) for i, j in pairs)).first()):
        cov[i, j] = cov[j, i] = v or 0.0
    return cov[:-1, :-1], cov[:-1, -1]


def nonnegative_by_sets(rows: DataFrame, features: list[str], target: str) -> dict[str, float]:
    """Non-negative least squares without intercept of up to four features: the best feasible solution of all active sets."""
    if not 1 <= len(features) <= 4:
        raise ValueError("one to four features are needed")
    gram, right = _products(rows, [*features, target], F.lit(1.0))
    best, least = np.zeros(len(features)), 0.0
    for size in range(1, len(features) + 1):
        for active in map(list, combinations(range(len(features)), size)):
            part = gram[np.ix_(active, active)]
            scale = np.sqrt(np.diag(part))
            if not scale.all() or np.linalg.det(part / np.outer(scale, scale)) <= 1e-12:
                continue
            found = np.linalg.solve(part, right[active])
            error = found @ part @ found - 2 * found @ right[active]
            if (found >= 0).all() and error < least:
                best, least = np.zeros(len(features)), error
                best[active] = found
    return dict(zip(features, best.tolist()))


def nonnegative_by_descent(rows: DataFrame, features: list[str], target: str, rounds: int = 50_000) -> dict[str, float]:
    """Non-negative least squares with intercept "fixed", rows weighted by 1 / max(target, 1), by coordinate descent on the sums."""
    gram, right = _products(rows.withColumn("fixed", F.lit(1.0)), ["fixed", *features, target], 1.0 / F.greatest(F.col(target).cast("double"), F.lit(1.0)))
    scale = np.sqrt(np.diag(gram))
    scale[scale == 0] = 1.0
    gram, right, found = gram / np.outer(scale, scale), right / scale, np.zeros(len(features) + 1)
    for _ in range(rounds):
        most = 0.0
        for k in range(len(found)):
            if gram[k, k]:
                new = max(0.0, found[k] + (right[k] - gram[k] @ found) / gram[k, k])
                most, found[k] = max(most, abs(new - found[k])), new
        if most <= 1e-10 * max(1.0, found.max()):
            break
    return dict(zip(["fixed", *features], (found / scale).tolist()))


def leave_one_out(rows: DataFrame, group: str, features: list[str], target: str, alpha: float = 0.0, weight: str | None = None) -> DataFrame:
    """rows with `predicted`: by the ridge fit (on standardised features) of all other groups; null where these have too few rows.

    One aggregate gives each group's sums of products about the overall means; all groups' less its own are the sums of its fit, so
    no row is read once for each fit. Groups are solved in tasks, and a prediction is a column over coefficients joined by group.
    Rows with a null feature, target or weight take no part in a fit; rows are weighted where `weight` is named.
    """
    n, w = len(features), F.col(weight).cast("double") if weight else F.lit(1.0)
    names = [*features, target]
    clean = rows.select(F.col(group).alias("g"), *(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)), w.alias("w")).dropna(subset=[*(f"c{i}" for i in range(n + 1)), "w"])
    middle = [x or 0.0 for x in clean.agg(*(F.sum(F.col("w") * F.col(f"c{i}")) / F.sum("w") for i in range(n + 1))).first()]
    at = [F.col(f"c{i}") - middle[i] for i in range(n + 1)]
    pairs = [(i, j) for i in range(n + 1) for j in range(i, n + 1)]
    sums = clean.groupBy("g").agg(F.array(F.sum("w"), *(F.sum(F.col("w") * x) for x in at), *(F.sum(F.col("w") * at[i] * at[j]) for i, j in pairs)).alias("own"))
    size = 1 + (n + 1) + len(pairs)
    whole = sums.agg(F.array(*(F.sum(F.col("own")[k]) for k in range(size))).alias("whole"))
    names_of = rows.select(F.col(group).alias("g")).distinct()
    groups = names_of.join(sums.withColumnRenamed("g", "g_"), F.col("g").eqNullSafe(F.col("g_")), "left")

    def solved(batches):
        import pandas as pd

        for frame in batches:
            out = []
            for own, whole in zip(frame["own"], frame["whole"]):
                out.append(None if whole is None else _held_out_fit(np.array(whole) - (0.0 if own is None else np.array(own)), n, alpha, middle))
            yield pd.DataFrame({"g": frame["g"], "coefficients": out})

    kind = rows.schema[group].dataType.simpleString()
    fits = groups.join(F.broadcast(whole)).select("g", "own", "whole").mapInPandas(solved, f"g {kind}, coefficients array<double>").withColumnRenamed("g", "g_")
    found = rows.join(fits, rows[group].eqNullSafe(F.col("g_")), "left").drop("g_")
    value = F.col("coefficients")[0]
    for i, c in enumerate(features):
        value = value + F.col("coefficients")[i + 1] * F.col(c).cast("double")
    return found.withColumn("predicted", value)


def _held_out_fit(sums: np.ndarray, n: int, alpha: float, middle: list[float]) -> list[float] | None:
    """[intercept, coefficients] from weighted sums (weight, firsts, products) about `middle`; None with the weight of fewer than two rows or a singular system."""
    weight, first, products = sums[0], sums[1 : n + 2], np.zeros((n + 1, n + 1))
    if weight < 1.5:
        return None
    upper = np.triu_indices(n + 1)
    products[upper] = products.T[upper] = sums[n + 2 :]
    cov = products - np.outer(first, first) / weight
    scale = np.sqrt(np.maximum(np.diag(cov)[:-1], 0.0))
    scale[scale <= 1e-12 * np.sqrt(weight)] = 1.0
    gram = cov[:-1, :-1] / np.outer(scale, scale) + alpha * np.eye(n)
    if np.linalg.matrix_rank(gram) < n:
        return None
    beta = np.linalg.solve(gram, cov[:-1, -1] / scale) / scale
    means = first / weight + np.array(middle)
    return [float(means[-1] - beta @ means[:-1]), *beta.tolist()]


def weighted_ridge(rows: DataFrame, features: list[str], target: str, weight: str, alpha: float = 1e-6) -> dict[str, float]:
    """Intercept ("fixed") and coefficients of the ridge fit on standardised features, each row as often as its weight says; {} where none can be found."""
    n, w = len(features), F.col("w")
    own = rows.select(*(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate([*features, target])), F.col(weight).cast("double").alias("w")).dropna()
    middle = [x or 0.0 for x in own.agg(*(F.sum(w * F.col(f"c{i}")) / F.sum(w) for i in range(n + 1))).first()]
    at = [F.col(f"c{i}") - middle[i] for i in range(n + 1)]
    sums = own.agg(F.sum(w), *(F.sum(w * x) for x in at), *(F.sum(w * at[i] * at[j]) for i in range(n + 1) for j in range(i, n + 1))).first()
    fit = _held_out_fit(np.array([x or 0.0 for x in sums]), n, alpha, middle)
    return dict(zip(["fixed", *features], fit)) if fit else {}
