"""Isolation forest over whole tables.

Trees are small by definition (256 rows each), so each is grown inside one task
from its own sample. The finished trees are a model of bounded size and are
broadcast; every row of the table is then scored where it lies.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.quantiles import quantiles
from tablewright.functions.scalars import as_column, measure
from tablewright.operators.profile import fit_moments
from tablewright.session import scratch_path

# Forest size, sample per tree, share flagged, seed.
TREES = 100
TREE_ROWS = 256
CONTAMINATION = 0.1
SEED = 42

OVERSAMPLE = 3  # rows drawn per wanted row before the exact cut
EULER_GAMMA = 0.5772156649

NODE_SCHEMA = "tree int, node int, feature int, split double, left int, right int, length double"


def average_path(m: float) -> float:
    """Mean depth of an unsuccessful search among ``m`` values."""
    if m <= 1:
        return 0.0
    if m == 2:
        return 1.0
    return 2.0 * (math.log(m - 1.0) + EULER_GAMMA) - 2.0 * (m - 1.0) / m


def _grow(values: np.ndarray, tree: int, seed: int) -> pd.DataFrame:
    """Split a sample at random until rows are alone or the depth limit is reached."""
    rng = np.random.default_rng([seed, tree])
    limit = math.ceil(math.log2(max(2, len(values))))
    nodes: list[list] = []

    def add(rows: np.ndarray, depth: int) -> int:
        node = len(nodes)
        nodes.append([tree, node, -1, 0.0, -1, -1, depth + average_path(len(rows))])
        span = rows.max(axis=0) - rows.min(axis=0) if len(rows) > 1 else np.zeros(values.shape[1])
        usable = np.flatnonzero(span > 0)
        if depth < limit and len(usable):
            feature = int(rng.choice(usable))
            low, high = rows[:, feature].min(), rows[:, feature].max()
            split = float(rng.uniform(low, high))
            below = rows[:, feature] <= split
            if below.all():  # rounding put the cut on the maximum
                below = rows[:, feature] < high
                split = float(rows[below, feature].max())
            nodes[node][2:4] = [feature, split]
            nodes[node][4] = add(rows[below], depth + 1)
            nodes[node][5] = add(rows[~below], depth + 1)
        return node

    add(values, 0)
    return pd.DataFrame(nodes, columns=["tree", "node", "feature", "split", "left", "right", "length"])


def tree_samples(
    df: DataFrame, key: str, features: Sequence[str], rows: int, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = SEED
) -> DataFrame:
    """Rows of each tree's sample: ``min(tree_rows, rows)`` different rows per tree.

    Each tree draws on its own by a seeded hash of row and tree, the same way at
    every size; a row that no tree draws goes no further.
    """
    wanted = min(tree_rows, rows)
    unit = F.lit(float(2**63))
    kept = df.select(as_column(key).alias("_key"), *[as_column(f) for f in features])
    share = min(1.0, OVERSAMPLE * wanted / max(1, rows))

    def drawn_by(tree: Column) -> Column:
        return F.abs(F.xxhash64(F.lit(seed), F.col("_key"), tree).cast("double")) <= F.lit(share) * unit

    drawn = kept.withColumn("tree", F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), drawn_by)))
    order = F.xxhash64(F.lit(seed + 2), F.col("_key"), F.col("tree"))
    # the limit is applied before the shuffle too, so a task sends few rows per tree
    ranked = drawn.withColumn("_rn", F.row_number().over(Window.partitionBy("tree").orderBy(order, "_key")))
    return ranked.where(F.col("_rn") <= wanted).drop("_rn", "_key")


def grow_forest(samples: DataFrame, features: Sequence[str], seed: int = SEED) -> DataFrame:
    """Nodes of all trees; each tree is grown from its own few rows."""
    names = list(features)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        # a fixed row order makes the tree independent of how rows arrived
        ordered = pdf.sort_values(names, kind="stable")
        return _grow(ordered[names].to_numpy(dtype=float), int(pdf["tree"].iloc[0]), seed)

    return samples.groupBy("tree").applyInPandas(grow, NODE_SCHEMA)


def _scorer(spark, nodes: pd.DataFrame, wanted: int) -> Column:
    """Vectorised score of a feature array against broadcast trees."""
    forest = []
    for _, tree in nodes.sort_values(["tree", "node"]).groupby("tree"):
        forest.append(
            (
                tree["feature"].to_numpy(),
                tree["split"].to_numpy(),
                tree["left"].to_numpy(),
                tree["right"].to_numpy(),
                tree["length"].to_numpy(),
            )
        )
    shared = spark.sparkContext.broadcast(forest)
    depth = math.ceil(math.log2(max(2, wanted)))
    norm = average_path(wanted) or 1.0

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        values = np.column_stack([c.to_numpy(dtype=float) for c in columns])
        rows = np.arange(len(values))
        total = np.zeros(len(values))
        for feature, split, left, right, length in shared.value:
            at = np.zeros(len(values), dtype=np.int64)
            for _ in range(depth):
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                below = values[rows, np.where(inner, f, 0)] <= split[at]
                at = np.where(inner, np.where(below, left[at], right[at]), at)
            total += length[at]
        return pd.Series(-np.power(2.0, -(total / len(shared.value)) / norm))

    return score


def isolation_forest(
    df: DataFrame,
    columns: Sequence[str],
    key: str,
    contamination: float = CONTAMINATION,
    trees: int = TREES,
    tree_rows: int = TREE_ROWS,
    seed: int = SEED,
    exact: bool = True,
) -> DataFrame:
    """Add ``anomaly_score`` and ``is_anomaly``; negative scores are anomalies.

    Features are z-scaled with the population deviation; a missing cell counts as
    the mean. The cut is the contamination quantile of all rows' scores.
    """
    moments = fit_moments(df, columns)
    features = [f"_f{i}" for i in range(len(columns))]
    scaled = {}
    for name, c in zip(features, columns):
        mean, std = moments[c]["mean"] or 0.0, moments[c]["std_pop"] or 0.0
        scaled[name] = (F.coalesce(measure(df, c), F.lit(mean)) - F.lit(mean)) / F.lit(std if std > 0 else 1.0)
    prepared = df.withColumns(scaled)
    rows = moments[columns[0]]["count"] + moments[columns[0]]["nulls"]
    samples = tree_samples(prepared, key, features, rows, trees, tree_rows, seed)
    nodes = grow_forest(samples, features, seed).toPandas()  # at most trees * 511 nodes
    score = _scorer(df.sparkSession, nodes, min(tree_rows, rows))
    scored = prepared.withColumn("_score", score(*[F.col(f) for f in features])).drop(*features)
    # rows are scored once: the search for the cut and the result read what is written here
    path = scratch_path(df.sparkSession, "scores")
    scored.write.parquet(path)
    scored = df.sparkSession.read.schema(scored.schema).parquet(path)
    offset = quantiles(scored, ["_score"], [contamination], exact)["_score"][0]
    value = F.col("_score") - F.lit(offset)
    return scored.withColumn("anomaly_score", value).withColumn("is_anomaly", value < 0).drop("_score")


def anomaly_stats(scored: DataFrame, contamination: float = CONTAMINATION) -> DataFrame:
    """Flagged rows, their percentage, all rows, and the share asked for."""
    flagged = F.count_if("is_anomaly")
    return scored.agg(
        flagged.alias("n_anomalies"),
        F.coalesce(F.try_divide(flagged * 100, F.count(F.lit(1))), F.lit(0.0)).alias("pct_anomalies"),
        F.count(F.lit(1)).alias("n_total"),
    ).withColumn("contamination", F.lit(float(contamination)))
