"""Gradient boosted trees over binned features with the losses of forecasts, grown level by level from histograms that Spark adds up."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.functions.sessions import cut

#: Trees after which the rows are written anew with what the trees say, so that plans stay short.
KEEP = 8
#: Accuracy of approximate percentiles: an error of one rank in so many.
ACCURACY = 10_000


@dataclass(frozen=True)
class Loss:
    """A loss of (actual, raw prediction): its value, first and second derivative by the raw prediction, the constant to begin with, whether the
    prediction is the raw one's exponential, and the percentile of what is left that a leaf takes in place of a Newton step."""

    name: str
    value: Callable[[Column, Column], Column]
    gradient: Callable[[Column, Column], Column]
    hessian: Callable[[Column, Column], Column]
    start: Callable[[Column], Column]
    exponential: bool = False
    renewed: float | None = None


def _one(y: Column, raw: Column) -> Column:
    return F.lit(1.0)


def _middle(y: Column, level: float = 0.5) -> Column:
    return F.percentile_approx(y, level, ACCURACY)


def squared() -> Loss:
    return Loss("squared", lambda y, r: (r - y) * (r - y) / 2, lambda y, r: r - y, _one, F.avg)


def absolute() -> Loss:
    return Loss("absolute", lambda y, r: F.abs(r - y), lambda y, r: F.signum(r - y), _one, _middle, renewed=0.5)


def quantile(level: float) -> Loss:
    """Under-estimates cost ``level``, over-estimates the rest to 1."""
    return Loss("quantile", lambda y, r: F.when(y > r, level * (y - r)).otherwise((1 - level) * (r - y)), lambda y, r: F.when(y > r, -level).otherwise(1 - level), _one, lambda y: _middle(y, level), renewed=level)


def huber(far: float) -> Loss:
    """Squared up to ``far``, then straight."""
    gap = lambda y, r: F.abs(r - y)
    return Loss("huber", lambda y, r: F.when(gap(y, r) <= far, gap(y, r) * gap(y, r) / 2).otherwise(far * (gap(y, r) - far / 2)), lambda y, r: F.greatest(F.lit(-far), F.least(F.lit(far), r - y)), _one, _middle)


def fair(scale: float) -> Loss:
    """Between squared and absolute, smooth everywhere."""
    gap = lambda y, r: F.abs(r - y)
    return Loss("fair", lambda y, r: scale * gap(y, r) - scale * scale * F.log1p(gap(y, r) / scale), lambda y, r: scale * (r - y) / (gap(y, r) + scale), lambda y, r: scale * scale / F.pow(gap(y, r) + scale, 2), _middle)


def poisson() -> Loss:
    """For counts: the prediction is the exponential of the raw one."""
    return Loss("poisson", lambda y, r: F.exp(r) - y * r, lambda y, r: F.exp(r) - y, lambda y, r: F.exp(r), lambda y: F.log(F.greatest(F.avg(y), F.lit(1e-9))), exponential=True)


def tweedie(power: float = 1.5) -> Loss:
    """For amounts with many zeros; ``power`` between 1 and 2."""
    a, b = 1 - power, 2 - power
    return Loss(
        "tweedie", lambda y, r: -y * F.exp(a * r) / a + F.exp(b * r) / b, lambda y, r: -y * F.exp(a * r) + F.exp(b * r), lambda y, r: -y * a * F.exp(a * r) + b * F.exp(b * r),
        lambda y: F.log(F.greatest(F.avg(y), F.lit(1e-9))), exponential=True,
    )


@dataclass
class Tree:
    """Splits by node (feature, bin: rows up to the bin's edge go to node 2n, others to 2n + 1), values of leaves, and what each split gained."""

    splits: dict[int, tuple[int, int]] = field(default_factory=dict)
    leaves: dict[int, float] = field(default_factory=dict)
    gains: dict[int, float] = field(default_factory=dict)


@dataclass
class Model:
    inputs: list[str]
    edges: list[list[float]]
    loss: Loss
    start: float
    rate: float
    trees: list[Tree]


def _walk(tree: Tree, goes_left: Callable[[int, int], Column], leaf: Callable[[int], Column], node: int = 1) -> Column:
    """The expression that leads a row to its leaf."""
    if node not in tree.splits:
        return leaf(node)
    return F.when(goes_left(*tree.splits[node]), _walk(tree, goes_left, leaf, 2 * node)).otherwise(_walk(tree, goes_left, leaf, 2 * node + 1))


def _by_bin(feature: int, edge: int) -> Column:
    return F.col("_bins")[feature] <= edge


def edges_of(rows: DataFrame, inputs: list[str], bins: int) -> list[list[float]]:
    """The upper edges of at most ``bins`` bins a feature, by approximate percentiles: one aggregation, and bins x features numbers for the driver."""
    levels = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.col(c).cast("double"), levels, ACCURACY).alias(f"_{i}") for i, c in enumerate(inputs)], *[F.max(F.col(c).cast("double")).alias(f"_top{i}") for i, c in enumerate(inputs)]).first()
    return [[e for e in sorted(set(found[f"_{i}"] or [])) if e < found[f"_top{i}"]] for i in range(len(inputs))]


def bin_of(column: Column, edges: list[float]) -> Column:
    """The number of edges below the value; a null goes to the first bin."""
    if not edges:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < column)), F.lit(0))


def histograms(rows: DataFrame, tree: Tree, nodes: list[int], loss: Loss) -> list:
    """For each of ``nodes``, feature and bin: sums of both derivatives and the number of rows. Partial sums are formed before the shuffle, and the driver
    gets nodes x features x bins rows at most."""
    y, raw = F.col("_y"), F.col("_raw")
    at = _walk(tree, _by_bin, F.lit)
    each = rows.select(at.alias("node"), "_bins", loss.gradient(y, raw).alias("g"), loss.hessian(y, raw).alias("h")).filter(F.col("node").isin(nodes))
    return each.select("node", "g", "h", F.posexplode("_bins").alias("feature", "bin")).groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n")).collect()


def _gain(g: float, h: float, ridge: float) -> float:
    return g * g / (h + ridge) if h + ridge > 0 else 0.0


def split_gains(rows: list, ridge: float, least: int) -> dict[int, list[tuple[float, int, int, tuple, tuple]]]:
    """By node, each split that leaves ``least`` rows on both sides: (gain, feature, bin, sums on the left, sums on the right)."""
    by_node: dict[int, dict[int, list]] = {}
    for r in rows:
        by_node.setdefault(r["node"], {}).setdefault(r["feature"], []).append((r["bin"], r["g"], r["h"], r["n"]))
    out = {}
    for node, features in by_node.items():
        first = next(iter(features.values()))
        g, h, n = (sum(x[i] for x in first) for i in (1, 2, 3))
        out[node] = []
        for feature, bins in sorted(features.items()):
            lg = lh = ln = 0
            for edge, bg, bh, bn in sorted(bins)[:-1]:
                lg, lh, ln = lg + bg, lh + bh, ln + bn
                if ln >= least and n - ln >= least:
                    gain = _gain(lg, lh, ridge) + _gain(g - lg, h - lh, ridge) - _gain(g, h, ridge)
                    out[node].append((gain, feature, edge, (lg, lh, ln), (g - lg, h - lh, n - ln)))
    return out


def _rounded(gain: float) -> float:
    """Sums of doubles differ in the last digits with their order: gains that agree in nine digits tie."""
    return float(f"{gain:.9g}")


def grown(rows: DataFrame, loss: Loss, depth: int, least: int, ridge: float) -> Tree:
    """A tree on (_y, _raw, _bins): at each level the best split of each node, of ties that of the first feature and bin; nodes without a gain are leaves."""
    tree, nodes = Tree(), [1]
    sums: dict[int, tuple] = {}
    for _ in range(depth):
        if not nodes:
            break
        found, deeper = split_gains(histograms(rows, tree, nodes, loss), ridge, least), []
        splits = {}
        for node, tried in found.items():
            best = max(tried, key=lambda s: (_rounded(s[0]), -s[1], -s[2]), default=None)
            if best and _rounded(best[0]) > 1e-12:
                splits[node], tree.gains[node] = (best[1], best[2]), best[0]
                sums[2 * node], sums[2 * node + 1] = best[3], best[4]
                deeper += [2 * node, 2 * node + 1]
        tree.splits |= splits
        nodes = deeper
    tree.leaves = {n: -g / (h + ridge) if h + ridge > 0 else 0.0 for n, (g, h, _) in sums.items() if n not in tree.splits} or {1: 0.0}
    if loss.renewed is not None:
        left = rows.select(_walk(tree, _by_bin, F.lit).alias("node"), (F.col("_y") - F.col("_raw")).alias("left"))
        tree.leaves = {r["node"]: r["v"] for r in left.groupBy("node").agg(_middle(F.col("left"), loss.renewed).alias("v")).collect()}  # 2**depth rows
    return tree


def fit(rows: DataFrame, inputs: list[str], target: str, loss: Loss | None = None, trees: int = 50, depth: int = 4, rate: float = 0.1, bins: int = 32, least: int = 20, ridge: float = 1.0, edges: list[list[float]] | None = None) -> Model:
    """Trees that lower ``loss`` on the rows whose target isn't null, each by ``rate`` of what it finds.

    A feature is cut into bins once; each level of a tree is one aggregation of both derivatives by (node, feature, bin), combined in the tasks,
    of which the driver gets 2**depth x features x bins rows at most. The loss is used through its derivatives alone; where its second one says nothing
    (absolute, quantile), leaves take a percentile of what is left. A null input counts as the smallest value, NaN as the largest. Without rows the model is 0.
    """
    loss = loss or squared()
    known = rows.filter(F.col(target).isNotNull()).select(F.col(target).cast("double").alias("_y"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(inputs)])
    names = [f"_x{i}" for i in range(len(inputs))]
    edges = edges or edges_of(known, names, bins)
    start = known.agg(loss.start(F.col("_y"))).first()[0]
    model = Model(inputs, edges, loss, 0.0 if start is None else float(start), rate, [])
    if start is None:
        return model
    bound = F.array(*[bin_of(F.col(c), e).cast("int") for c, e in zip(names, edges)])
    state = cut(known.select("_y", F.lit(model.start).alias("_raw"), bound.alias("_bins")))
    since = 0
    for _ in range(trees):
        tree = grown(state, loss, depth, least, ridge)
        model.trees.append(tree)
        if not tree.splits and loss.renewed is None:
            break
        step = _walk(tree, _by_bin, lambda n, tree=tree: F.lit(rate * tree.leaves.get(n, 0.0)))
        state, since = state.withColumn("_raw", F.col("_raw") + step), since + 1
        if since == KEEP:
            state, since = cut(state), 0
    return model


def raw(model: Model) -> Column:
    """The sum of the trees as an expression over the inputs."""

    def goes_left(feature: int, edge: int) -> Column:
        return F.coalesce(F.col(model.inputs[feature]).cast("double") <= model.edges[feature][edge], F.lit(True))

    out = F.lit(model.start)
    for tree in model.trees:
        out = out + _walk(tree, goes_left, lambda n, tree=tree: F.lit(model.rate * tree.leaves.get(n, 0.0)))
    return out


def predict(model: Model, rows: DataFrame, name: str = "predicted") -> DataFrame:
    """The rows with the model's prediction."""
    return rows.withColumn(name, F.exp(raw(model)) if model.loss.exponential else raw(model))


def mean_loss(model: Model, rows: DataFrame, target: str, loss: Loss | None = None) -> DataFrame:
    """One row: the model's mean loss on the rows, by its own loss or another of the same link."""
    return rows.filter(F.col(target).isNotNull()).agg(F.avg((loss or model.loss).value(F.col(target).cast("double"), raw(model))).alias("loss"))


def importances(model: Model) -> dict[str, float]:
    """The share of all gains that splits on each input made; 0 for all where nothing was gained."""
    sums = dict.fromkeys(model.inputs, 0.0)
    for tree in model.trees:
        for node, gain in tree.gains.items():
            sums[model.inputs[tree.splits[node][0]]] += gain
    total = sum(sums.values())
    return {k: v / total if total else 0.0 for k, v in sums.items()}
