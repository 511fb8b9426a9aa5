"""Out-of-fold predictions of least squares: each fold's model comes from sums that were added up once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_of(rows: DataFrame) -> DataFrame:
    """ISO year and week as fold; a week is left out as a whole."""
    return rows.withColumn("fold", F.extract(F.lit("YEAROFWEEK"), "date") * 100 + F.weekofyear("date"))


def statistics(rows: DataFrame, inputs: list[str], target: str, keys: list[str]) -> DataFrame:
    """By keys: n, and ``gram``, the sums of the products of each two of (1, inputs.., target), as the rows of the upper triangle.

    The products are summed in the tasks, so a fold of any size is one row per task. Rows with a null among inputs and target don't count.
    """
    columns = [F.lit(1.0), *[F.col(c).cast("double") for c in inputs], F.col(target).cast("double")]
    full = rows.dropna(subset=[*inputs, target])
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    return full.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*[F.sum(columns[i] * columns[j]) for i, j in pairs]).alias("gram"))


def _solved(gram: np.ndarray, ridge: float) -> list[float]:
    """Weights of (1, inputs..) from a symmetric matrix of sums; ``ridge`` holds back all but the first. Without a single solution, the shortest one."""
    left, right = gram[:-1, :-1].copy(), gram[:-1, -1]
    left[np.arange(1, len(left)), np.arange(1, len(left))] += ridge
    scale = np.sqrt(np.maximum(np.diag(left), 1e-300))
    return (np.linalg.lstsq(left / np.outer(scale, scale), right / scale, rcond=1e-12)[0] / scale).tolist()


def out_of_fold(rows: DataFrame, inputs: list[str], target: str, fold: str = "fold", forward: Column | None = None, by: list[str] | None = None, ridge: float = 0.0, least: int = 2) -> DataFrame:
    """The rows with ``n_train`` and ``predicted``: least squares on (1, inputs..) fitted without the row's fold.

    Rows are parted by ``by`` and by whether ``forward`` holds; each part is a model of its own. Where ``forward`` holds (weekends, as the rule has it) only earlier folds
    train, elsewhere all others. One pass adds up a matrix of sums per fold: the total less the fold's own gives all others, a running sum the earlier ones, so no fold is fitted from rows again. The driver gets a small matrix for
    each part and fold, of which there are as many as weeks. ``predicted`` is null where fewer than ``least`` rows train or an input is null; it is at least 0.
    """
    forward = F.lit(False) if forward is None else F.coalesce(forward, F.lit(False))
    by = by or []
    marked = rows.withColumn("_forward", forward)
    sums = statistics(marked, inputs, target, [*by, "_forward", fold]).collect()
    width = len(inputs) + 2
    upper = np.triu_indices(width)
    parts: dict[tuple, list] = {}
    for r in sums:
        gram = np.zeros((width, width))
        gram[upper] = r["gram"]
        parts.setdefault((*[r[c] for c in by], r["_forward"]), []).append((r[fold], r["n"], gram + np.triu(gram, 1).T))
    solved = []
    for part, folds in parts.items():
        folds.sort(key=lambda f: f[0])
        total_n, total = sum(n for _, n, _ in folds), sum(g for _, _, g in folds)
        before_n, before = 0, np.zeros((width, width))
        for name, n, gram in folds:
            n_train, sums_of = (before_n, before) if part[-1] else (total_n - n, total - gram)
            solved.append((*part, name, n_train, _solved(sums_of, ridge) if n_train >= max(1, least) else None))
            before_n, before = before_n + n, before + gram
    kinds = dict(marked.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*by, "_forward", fold]) + ", n_train long, _weights array<double>"
    table = rows.sparkSession.createDataFrame(solved, schema)
    out = marked.join(F.broadcast(table), [*by, "_forward", fold], "left")  # a row per part and fold
    value = F.col("_weights")[0]
    for i, c in enumerate(inputs):
        value = value + F.col("_weights")[i + 1] * F.col(c).cast("double")
    made = F.when(value.isNotNull(), F.greatest(F.lit(0.0), value))
    return out.withColumns({"n_train": F.coalesce("n_train", F.lit(0)), "predicted": made}).select(*rows.columns, "n_train", "predicted")
