import numpy as np
import pandas as pd
import pytest

from tablewright.operators import cluster
from tablewright.operators.cluster import connected_components, dbscan


def brute(points, eps, min_samples):
    """Textbook clustering by all pairs; clusters numbered by smallest core row."""
    gap = ((points[:, None, :] - points[None, :, :]) ** 2).sum(-1)
    near = gap <= eps * eps
    core = near.sum(1) >= min_samples
    label = np.full(len(points), -1)
    number = 0
    for i in range(len(points)):
        if core[i] and label[i] < 0:
            stack, label[i] = [i], number
            while stack:
                for j in np.flatnonzero(near[stack.pop()] & core):
                    if label[j] < 0:
                        label[j] = number
                        stack.append(j)
            number += 1
    for i in range(len(points)):
        if not core[i]:
            found = label[np.flatnonzero(near[i] & core)]
            label[i] = found.min() if len(found) else -1
    return label


def shapes(name):
    rng = np.random.default_rng(3)
    if name == "blobs":
        return np.vstack([rng.normal(0, 0.3, (120, 2)), rng.normal(3, 0.3, (120, 2)), rng.uniform(-3, 6, (40, 2))])
    if name == "hot":  # one crowded spot, copies, and a ring around it
        angle = rng.uniform(0, 2 * np.pi, 80)
        ring = np.c_[np.cos(angle), np.sin(angle)] * 0.52
        spots = [rng.normal(0, 0.02, (400, 2)), rng.normal(0, 0.02, (200, 2)) + [0.63, 0.0], rng.normal(0, 0.02, (200, 2)) + [0.0, 0.59]]
        return np.vstack([np.zeros((50, 2)), ring, *spots])
    if name == "line":
        return np.c_[np.arange(300) * 0.2, np.zeros(300)]
    if name == "volume":
        return np.vstack([rng.normal(0, 0.4, (150, 3)), rng.normal(2, 0.4, (150, 3))])
    return np.vstack([rng.normal(0, 0.12, (120, 6)), rng.normal(0.6, 0.12, (120, 6))])


@pytest.mark.parametrize(
    "name,direct,crowded",
    [("blobs", 10_000, 2000), ("hot", 4, 2000), ("line", 4, 2000), ("volume", 10, 2000), ("wide", 100, 2)],
)
def test_matches_brute_force(spark, name, direct, crowded):
    points = shapes(name)
    pdf = pd.DataFrame(points, columns=[f"f{i}" for i in range(points.shape[1])])
    columns = list(pdf)
    pdf["id"] = np.arange(len(pdf))
    df = spark.createDataFrame(pdf).repartition(5)
    got = dbscan(df, columns, "id", eps=0.5, min_samples=5, scale=False, direct_pairs=direct, crowded_bucket=crowded, few_points=max(1, direct // 4))
    label = got.select("id", "cluster").toPandas().sort_values("id")["cluster"].to_numpy()
    assert (label == brute(points, 0.5, 5)).all()


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501)]
    roots = connected_components(spark.createDataFrame(edges, "a long, b long")).toPandas()
    groups = roots.groupby("root")["node"].apply(set).tolist()
    assert sorted(map(len, groups)) == [2, 201]


def test_crowded_cell_is_counted_by_boxes(spark, monkeypatch):
    """Nine tenths of the distinct points in one cell: what single points are compared with does not grow with them."""
    rng, compared = np.random.default_rng(5), {}
    angle = rng.uniform(0, 2 * np.pi, 120)
    ring = np.c_[np.cos(angle), np.sin(angle)] * rng.uniform(0.4, 0.62, 120)[:, None]
    for size in (1_000, 16_000):
        points = np.vstack([ring, np.abs(rng.normal(0, 0.03, (size, 2)))])
        pdf = pd.DataFrame(points, columns=["f0", "f1"]).assign(id=np.arange(len(points)))
        seen = []

        def watched(df, seen=seen):
            out = original(df)
            if "few" in out.columns and "b_m" in out.columns:
                seen.append(out.selectExpr("sum(if(few AND NOT full, b_m, 0)) + count(1)").first()[0] or 0)
            return out

        original = cluster.checkpoint
        with monkeypatch.context() as patch:
            patch.setattr(cluster, "checkpoint", watched)
            got = dbscan(spark.createDataFrame(pdf).repartition(4), ["f0", "f1"], "id", eps=0.5, min_samples=20, scale=False, few_points=16)
        label = got.select("id", "cluster").toPandas().sort_values("id")["cluster"].to_numpy()
        if size == 1_000:
            assert (label == brute(points, 0.5, 20)).all()
        compared[size] = sum(seen)
    assert compared[1_000] > 0 and compared[16_000] < 2 * compared[1_000] + 20_000
