"""Density clustering of whole tables.

A fine grid makes every cell so small that all its points are neighbours of each
other. A cell that holds enough points is therefore dense as a whole, and most
of the work happens between cells instead of between points:

* identical points are merged first and keep a weight;
* a point of a sparse cell, which holds fewer points than the density threshold,
  counts its neighbours in a dense cell by boxes: one wholly in reach counts as
  a whole, one out of reach is dropped, others are split. The count ends when it
  reaches the threshold;
* two dense cells are joined if any two of their points are close. That is
  decided on bounding boxes, which are split where the boxes leave it open.

Points are compared one by one only between sparse cells and with boxes of a
bounded number of points, so no step pairs up the points of a crowded cell, and
one cell may hold any share of the table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.ranking import ordered_row_number
from tablewright.functions.scalars import as_column, measure
from tablewright.operators.profile import fit_moments
from tablewright.session import checkpoint

# The density parameters used when none are given.
EPS = 0.5
MIN_SAMPLES = 5

GRID_DIMENSIONS = 4  # dimensions added to the grid key at a time
CROWDED_BUCKET = 2_000  # cells in a grid bucket beyond which more dimensions are used
DIRECT_PAIRS = 10_000  # point pairs of two boxes up to which they are simply compared
FEW_POINTS = 256  # points of a box up to which a point is simply compared with them
SPLIT = 4  # parts a box is cut into along each dimension

NOISE = -1


def _total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _min_square(a: str, b: str, d: int) -> Column:
    """Squared distance between two bounding boxes; column prefixes name the boxes."""
    gaps = [
        F.greatest(F.lit(0.0), F.col(f"{b}lo{i}") - F.col(f"{a}hi{i}"), F.col(f"{a}lo{i}") - F.col(f"{b}hi{i}"))
        for i in range(d)
    ]
    return _total([g * g for g in gaps])


def _max_square(a: str, b: str, d: int) -> Column:
    """Squared distance between the farthest corners of two bounding boxes."""
    gaps = [
        F.greatest(F.col(f"{b}hi{i}") - F.col(f"{a}lo{i}"), F.col(f"{a}hi{i}") - F.col(f"{b}lo{i}")) for i in range(d)
    ]
    return _total([g * g for g in gaps])


def _point_square(a: str, b: str, d: int) -> Column:
    gaps = [F.col(f"{a}x{i}") - F.col(f"{b}x{i}") for i in range(d)]
    return _total([g * g for g in gaps])


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in df.columns])


def _box(d: int) -> list[Column]:
    return [f(f"x{i}").alias(f"{n}{i}") for i in range(d) for n, f in (("lo", F.min), ("hi", F.max))]


def _neighbour_cells(cells: DataFrame, d: int, reach: int, eps2: float, crowded: int) -> DataFrame:
    """Ordered pairs of different cells whose boxes are within reach of each other.

    Cells are found through a coarse grid on the first few dimensions. Where a
    coarse bucket is crowded the next dimensions join its key, so the number of
    cells compared stays small however the cells are spread.
    """
    grid = cells.withColumn("coarse", F.transform("cell", lambda c: F.floor(c / F.lit(reach))))
    requests = _prefixed(grid, "a_")
    found, asked, targets, start = None, [], grid, 0
    while True:
        stop = min(d, start + GRID_DIMENSIONS)
        name, first, width = f"key{start}", start + 1, stop - start
        steps = F.array(*[F.array(*[F.lit(v).cast("long") for v in o]) for o in product((-1, 0, 1), repeat=width)])
        requests = requests.withColumn("step", F.explode(steps))
        requests = requests.withColumn(
            name, F.zip_with(F.slice("a_coarse", first, width), "step", lambda c, o: c + o)
        ).drop("step")
        targets = targets.withColumn(name, F.slice("coarse", first, width))
        asked.append(name)
        sizes = targets.groupBy(*asked).agg(F.count(F.lit(1)).alias("bucket"))
        sized = requests.join(sizes, asked)  # a request for an empty bucket ends here
        last = stop == d
        ready = sized if last else sized.where(F.col("bucket") <= crowded)
        there = targets.select(*asked, *[F.col(c).alias(f"b_{c}") for c in cells.columns])
        pairs = ready.drop("bucket").join(there, asked)
        pairs = pairs.where((F.col("a_cell") != F.col("b_cell")) & (_min_square("a_", "b_", d) <= eps2))
        pairs = pairs.drop(*asked, "a_coarse")
        found = pairs if found is None else found.unionByName(pairs)
        if last:
            return found
        requests = sized.where(F.col("bucket") > crowded).drop("bucket")
        if not requests.limit(1).count():
            return found
        start = stop


def _close_cells(points: DataFrame, pairs: DataFrame, d: int, side: float, eps2: float, direct: int) -> DataFrame:
    """Pairs of dense cells ``(a_cell, b_cell)`` that hold two points within reach.

    Boxes of a pair are split again and again. A pair is settled when two boxes
    lie wholly within reach, or when no two boxes can be; boxes with few points
    are compared point by point.
    """
    settled = None
    level = 0
    at = points.drop("pid", "w").withColumn("box", F.col("cell"))
    boxes = at.groupBy("cell", "box").agg(F.count(F.lit(1)).alias("n"), *_box(d))
    facing = pairs.select("a_cell", "b_cell", F.col("a_cell").alias("a_box"), F.col("b_cell").alias("b_box"))
    while True:
        facing = (
            facing.join(_prefixed(boxes, "a_"), ["a_cell", "a_box"])
            .join(_prefixed(boxes, "b_"), ["b_cell", "b_box"])
            .where(_min_square("a_", "b_", d) <= eps2)
            .select(
                "a_cell",
                "b_cell",
                "a_box",
                "b_box",
                (_max_square("a_", "b_", d) <= eps2).alias("hit"),
                (F.col("a_n") * F.col("b_n") <= direct).alias("few"),
            )
        )
        facing = checkpoint(facing)
        hits = facing.where("hit").select("a_cell", "b_cell").distinct()
        left = facing.where("NOT hit").join(hits, ["a_cell", "b_cell"], "left_anti")
        compared = (
            left.where("few")
            .select("a_cell", "b_cell", "a_box", "b_box")
            .join(_prefixed(at, "a_"), ["a_cell", "a_box"])
            .join(_prefixed(at, "b_"), ["b_cell", "b_box"])
            .where(_point_square("a_", "b_", d) <= eps2)
            .select("a_cell", "b_cell")
        )
        hits = checkpoint(hits.unionByName(compared).distinct())
        settled = hits if settled is None else settled.unionByName(hits)
        unclear = left.where("NOT few").select("a_cell", "b_cell", "a_box", "b_box")
        unclear = checkpoint(unclear.join(hits, ["a_cell", "b_cell"], "left_anti"))
        if not unclear.limit(1).count():
            return settled
        level += 1
        width = side / SPLIT**level
        finer = F.array(*[F.floor(F.col(f"x{i}") / F.lit(width)) for i in range(d)])
        involved = (
            unclear.select(F.col("a_cell").alias("cell"), F.col("a_box").alias("box"))
            .unionByName(unclear.select(F.col("b_cell").alias("cell"), F.col("b_box").alias("box")))
            .distinct()
        )
        at = at.join(involved, ["cell", "box"]).withColumnRenamed("box", "parent").withColumn("box", finer)
        at = checkpoint(at)
        family = at.select("cell", "parent", "box").distinct()
        facing = (
            unclear.withColumnRenamed("a_box", "a_parent")
            .withColumnRenamed("b_box", "b_parent")
            .join(_prefixed(family, "a_"), ["a_cell", "a_parent"])
            .join(_prefixed(family, "b_"), ["b_cell", "b_parent"])
            .select("a_cell", "b_cell", "a_box", "b_box")
            .distinct()
        )
        at = at.drop("parent")
        boxes = at.groupBy("cell", "box").agg(F.count(F.lit(1)).alias("n"), *_box(d))


def _reach_counts(
    asking: DataFrame, pairs: DataFrame, points: DataFrame, d: int, side: float, eps2: float, enough: int, few: int
) -> DataFrame:
    """Neighbours of single points in dense cells, as ``(pid, a_cell, b_cell, found)`` with ``found`` above 0.

    ``asking`` has ``pid``, ``cell``, the coordinates and ``known``, the neighbours counted elsewhere. Boxes of the
    dense cell are taken or dropped as a whole, compared point by point if they hold ``few`` points, or split. A point
    that has ``enough`` neighbours and one in the cell at hand looks no further, so its counts may stay below the truth,
    but not below ``enough``.
    """
    told, level = None, 0
    pair = ["a_pid", "a_cell", "b_cell"]
    place = [f"a_x{i}" for i in range(d)]
    at = points.join(pairs.select(F.col("b_cell").alias("cell")).distinct(), "cell", "left_semi")
    at = at.select("cell", "w", *[f"x{i}" for i in range(d)]).withColumn("box", F.col("cell"))
    facing = _prefixed(asking, "a_").join(pairs.select("a_cell", "b_cell"), "a_cell").withColumn("b_box", F.col("b_cell"))
    least = _total([F.pow(F.greatest(F.lit(0.0), F.col(f"b_lo{i}") - F.col(f"a_x{i}"), F.col(f"a_x{i}") - F.col(f"b_hi{i}")), 2) for i in range(d)])
    most = _total([F.pow(F.greatest(F.col(f"b_hi{i}") - F.col(f"a_x{i}"), F.col(f"a_x{i}") - F.col(f"b_lo{i}")), 2) for i in range(d)])
    while True:
        boxes = at.groupBy("cell", "box").agg(F.sum("w").alias("n"), F.count(F.lit(1)).alias("m"), *_box(d))
        facing = facing.join(_prefixed(boxes, "b_"), ["b_cell", "b_box"]).where(least <= eps2)
        facing = facing.select(*pair, *place, "a_known", "b_box", "b_n", "b_m", (most <= eps2).alias("full"), (F.col("b_m") <= few).alias("few"))
        facing = checkpoint(facing)
        whole = facing.where("full").select(*pair, F.col("b_n").alias("found"))
        compared = facing.where("few AND NOT full").join(_prefixed(at, "b_"), ["b_cell", "b_box"])
        compared = compared.where(_point_square("a_", "b_", d) <= eps2).select(*pair, F.col("b_w").alias("found"))
        found = whole.unionByName(compared)
        found = found if told is None else found.unionByName(told)
        told = checkpoint(found.groupBy(*pair).agg(F.sum("found").alias("found")))
        unclear = facing.where("NOT full AND NOT few").drop("b_n", "b_m", "full", "few")
        if unclear.limit(1).count():
            sums = told.groupBy("a_pid").agg(F.sum("found").alias("sum"))
            met = told.select(*pair, F.lit(True).alias("met"))
            unclear = unclear.join(sums, "a_pid", "left").join(met, pair, "left")
            done = F.col("met") & (F.col("a_known") + F.col("sum") >= enough)
            unclear = checkpoint(unclear.where(~F.coalesce(done, F.lit(False))).drop("sum", "met"))
        if not unclear.limit(1).count():
            return told.select(F.col("a_pid").alias("pid"), "a_cell", "b_cell", "found")
        level += 1
        finer = F.array(*[F.floor(F.col(f"x{i}") / F.lit(side / SPLIT**level)) for i in range(d)])
        involved = unclear.select(F.col("b_cell").alias("cell"), F.col("b_box").alias("box")).distinct()
        at = checkpoint(at.join(involved, ["cell", "box"]).withColumnRenamed("box", "parent").withColumn("box", finer))
        family = at.select(F.col("cell").alias("b_cell"), F.col("parent").alias("b_parent"), F.col("box").alias("b_box")).distinct()
        facing = unclear.withColumnRenamed("b_box", "b_parent").join(family, ["b_cell", "b_parent"]).drop("b_parent")
        at = at.drop("parent")


def connected_components(edges: DataFrame) -> DataFrame:
    """Component of every node that has an edge, as ``(node, root)``.

    In each round every node joins the neighbour that comes first in a random
    order, and joined nodes become one, so the graph shrinks by a constant
    factor per round even where it is a long chain.
    """
    current = checkpoint(edges.select("a", "b").where("a != b").distinct())
    maps: list[DataFrame] = []
    while current.limit(1).count():
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        turn = len(maps)

        def place(c: str) -> Column:
            return F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("node"))

        nearest = both.groupBy("a").agg(F.min(place("b")).alias("best"))
        step = nearest.select(F.col("a").alias("node"), F.least(place("a"), F.col("best"))["node"].alias("parent"))
        step = checkpoint(step)
        maps.append(step)
        moved = current.join(step.toDF("a", "a2"), "a").join(step.toDF("b", "b2"), "b")
        current = checkpoint(moved.select(F.col("a2").alias("a"), F.col("b2").alias("b")).where("a != b").distinct())
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    # compose from the smallest map back to the first
    roots = maps[-1].toDF("node", "root")
    for step in reversed(maps[:-1]):
        up = roots.toDF("parent", "root")
        roots = checkpoint(step.join(up, "parent", "left").select("node", F.coalesce("root", "parent").alias("root")))
    return roots


def dbscan(
    df: DataFrame,
    columns: Sequence[str],
    key: str,
    eps: float = EPS,
    min_samples: int = MIN_SAMPLES,
    scale: bool = True,
    direct_pairs: int = DIRECT_PAIRS,
    crowded_bucket: int = CROWDED_BUCKET,
    few_points: int = FEW_POINTS,
) -> DataFrame:
    """Add ``cluster``: the density cluster of each row, or -1 for noise.

    A point is a core point if at least ``min_samples`` rows, itself included,
    lie within ``eps``. Clusters are connected core points, numbered from 0 by
    their smallest core key. Other points within reach of a core point join the
    lowest-numbered of the clusters they touch. Features are z-scaled with the
    population deviation first; a missing cell counts as the mean.
    """
    d = len(columns)
    moments = fit_moments(df, columns)
    coords = []
    for i, c in enumerate(columns):
        mean, std = moments[c]["mean"] or 0.0, moments[c]["std_pop"] or 0.0
        v = F.coalesce(measure(df, c), F.lit(mean))
        if scale:
            v = (v - F.lit(mean)) / F.lit(std if std > 0 else 1.0)
        coords.append((v + F.lit(0.0)).alias(f"x{i}"))
    xs = [f"x{i}" for i in range(d)]
    eps2 = float(eps) * float(eps)
    side = eps / math.sqrt(d) * (1 - 1e-9)
    reach = math.floor(math.sqrt(d)) + 1  # cells a coarse bucket spans, so that it is at least eps wide
    placed = df.select(as_column(key).alias("pid"), *coords)
    cell = F.array(*[F.floor(F.col(x) / F.lit(side)) for x in xs])
    points = placed.groupBy(*xs).agg(F.count(F.lit(1)).alias("w"), F.min("pid").alias("pid")).withColumn("cell", cell)
    points = checkpoint(points)
    cells = points.groupBy("cell").agg(F.sum("w").alias("weight"), *_box(d))
    cells = checkpoint(cells.withColumn("dense", F.col("weight") >= min_samples))
    near = _neighbour_cells(cells, d, reach, eps2, crowded_bucket)
    pairs = near.withColumn("full", _max_square("a_", "b_", d) <= eps2)
    pairs = checkpoint(pairs.select("a_cell", "b_cell", "a_dense", "b_dense", "full", "b_weight"))

    # points of sparse cells: neighbours in the own cell and in cells wholly within reach
    sure = pairs.where("NOT a_dense AND full").groupBy(F.col("a_cell").alias("cell")).agg(F.sum("b_weight").alias("sure"))
    sparse = points.join(cells.where("NOT dense").select("cell", "weight"), "cell")
    # neighbours in sparse cells partly within reach, point by point
    doubtful = pairs.where("NOT a_dense AND NOT full").select("a_cell", "b_cell", "b_dense")
    few = (
        _prefixed(sparse.drop("weight", "w"), "a_")
        .join(doubtful.where("NOT b_dense"), "a_cell")
        .join(_prefixed(points, "b_"), "b_cell")
        .where(_point_square("a_", "b_", d) <= eps2)
        .select(F.col("a_pid").alias("pid"), "a_cell", "b_cell", "b_dense", F.col("b_pid").alias("q"), F.col("b_w").alias("found"))
    )
    # of a dense cell only the number of neighbours matters, and that only up to the threshold
    known = (F.col("weight") + F.coalesce("sure", F.lit(0))).alias("known")
    asking = sparse.join(sure, "cell", "left").select("pid", "cell", *xs, known)
    counts = _reach_counts(asking, doubtful.where("b_dense"), points, d, side, eps2, min_samples, few_points)
    counts = counts.select("pid", "a_cell", "b_cell", F.lit(True).alias("b_dense"), F.lit(None).cast(points.schema["pid"].dataType).alias("q"), "found")
    touched = checkpoint(few.unionByName(counts))
    neighbours = F.col("weight") + F.coalesce("sure", F.lit(0)) + F.coalesce("found", F.lit(0))
    counted = checkpoint(
        sparse.join(sure, "cell", "left")
        .join(touched.groupBy("pid").agg(F.sum("found").alias("found")), "pid", "left")
        .select("pid", "cell", (neighbours >= min_samples).alias("core"))
    )
    crowd = points.join(cells.where("dense").select("cell"), "cell")
    core_points = crowd.select("pid", "cell").unionByName(counted.where("core").select("pid", "cell"))
    nodes = checkpoint(core_points.groupBy("cell").agg(F.min("pid").alias("node")))

    # edges between cells that hold core points
    core = counted.where("core").select("pid")
    core_q = core.withColumnRenamed("pid", "q")
    ends = ["a_cell", "b_cell"]
    links = (
        pairs.where("full").select(*ends)
        .unionByName(touched.where("b_dense").join(core, "pid", "left_semi").select(*ends))
        .unionByName(
            touched.where("NOT b_dense").join(core, "pid", "left_semi").join(core_q, "q", "left_semi").select(*ends)
        )
        .unionByName(
            _close_cells(
                crowd, pairs.where("a_dense AND b_dense AND NOT full AND a_cell < b_cell"), d, side, eps2, direct_pairs
            )
        )
    )
    edges = links.join(nodes.toDF("a_cell", "a"), "a_cell").join(nodes.toDF("b_cell", "b"), "b_cell").select("a", "b")
    labelled = nodes.join(connected_components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))
    numbers = ordered_row_number(labelled.groupBy("root").agg(F.min("node").alias("first")), ["first"], "rn")
    clusters = labelled.join(numbers.select("root", (F.col("rn") - 1).alias("cluster")), "root").select("cell", "cluster")
    clusters = checkpoint(clusters)

    # other points take the lowest cluster they touch
    border = counted.where("NOT core").select("pid", "cell")
    whole = pairs.where("full").select(F.col("a_cell").alias("cell"), F.col("b_cell").alias("touch"))
    near_core = touched.where("b_dense").select("pid", F.col("b_cell").alias("touch")).unionByName(
        touched.where("NOT b_dense").join(core_q, "q", "left_semi").select("pid", F.col("b_cell").alias("touch"))
    )
    touching = (
        border.select("pid", F.col("cell").alias("touch"))
        .unionByName(border.join(whole, "cell").select("pid", "touch"))
        .unionByName(near_core.join(border.select("pid"), "pid", "left_semi"))
    )
    adopted = (
        touching.join(clusters.withColumnRenamed("cell", "touch"), "touch")
        .groupBy("pid")
        .agg(F.min("cluster").alias("cluster"))
    )
    of_point = core_points.join(clusters, "cell").select("pid", "cluster").unionByName(adopted)
    of_place = points.join(of_point, "pid", "left").select(
        *xs, F.coalesce("cluster", F.lit(NOISE)).cast("long").alias("cluster")
    )
    rows = df.withColumns({f"_{x}": c for x, c in zip(xs, coords)})
    same = reduce(lambda a, b: a & b, [F.col(f"_{x}") == F.col(x) for x in xs])
    return rows.join(of_place, same).drop(*xs, *[f"_{x}" for x in xs])


def cluster_stats(clustered: DataFrame) -> DataFrame:
    """Rows per cluster, with the number of clusters, noise and all rows alongside."""
    sizes = clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_rows"))
    total = sizes.agg(
        F.count_if(F.col("cluster") != NOISE).alias("n_clusters"),
        F.coalesce(F.sum(F.when(F.col("cluster") == NOISE, F.col("n_rows"))), F.lit(0)).alias("n_noise"),
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_total"),
    )
    # the right side is a single row
    return sizes.crossJoin(total)
