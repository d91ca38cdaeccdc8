"""Exact quantiles of many columns at once, in bounded memory and mostly two scans.

``percentile`` keeps every distinct value of a column in one task, and a global
sort moves the whole table. Here one scan gives each column's moments and a
mergeable sketch, whose quantiles bracket each wanted rank. A second scan counts
the rows in the regions that the brackets cut, and of the regions that are small
enough to rank it also counts the values. Where a bracket is still too large, or
the sketch was wrong, the next round goes on inside the region that holds the
rank. The sketch only steers the search: every answer is verified by counting.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.scalars import as_column, measure

SMALL_BRACKET = 100_000  # rows up to which a bracket is ranked
SKETCH_SIZE = 1000
SKETCH_SLACK = 0.006  # about twice the rank error of a sketch of that size
COLUMNS_PER_SCAN = 50  # columns whose moments and sketches one scan gathers, to bound generated code
SKETCH_SHARDS = 64  # sketches merged in two steps, so no task merges one per input split


@dataclass
class _Target:
    """One wanted rank of one column, and the open interval known to hold it."""

    column: str
    prob: float
    rank: int
    inside: int  # values strictly between low and high
    low: float = float("-inf")
    high: float = float("inf")
    below: int = 0  # values up to and including low
    answer: float | None = None

    @property
    def interval(self) -> tuple[str, float, float]:
        return self.column, self.low, self.high


@dataclass
class Summary:
    """What one scan tells about a column: its moments, and values of the sketch around each asked probability."""

    moments: dict[str, dict]
    around: dict[str, list[list[float]]]


def _ranks(n: int, prob: float, interpolate: bool) -> tuple[int, int, float]:
    """Lower rank, upper rank and weight of the upper one."""
    if interpolate:
        position = prob * (n - 1)
        return math.floor(position), math.ceil(position), position - math.floor(position)
    k = min(n - 1, math.floor(n * prob))
    return k, k, 0.0


def _within(t: _Target) -> Column:
    c = as_column(t.column)
    return (c > F.lit(t.low)) & (c < F.lit(t.high))


def _shard() -> Column:
    return F.pmod(F.spark_partition_id(), F.lit(SKETCH_SHARDS)).alias("shard")


def _sketch_quantiles(df: DataFrame, wanted: dict[str, tuple[Column, list[float]]]) -> dict[str, list[float]]:
    """Approximate quantiles of each expression, merged in two steps."""
    names = list(wanted)
    parts = df.groupBy(_shard()).agg(
        *[F.kll_sketch_agg_double(wanted[n][0], F.lit(SKETCH_SIZE)).alias(f"s{i}") for i, n in enumerate(names)]
    )
    merged = parts.agg(*[F.kll_merge_agg_double(f"s{i}").alias(f"s{i}") for i in range(len(names))])
    row = merged.select(
        *[
            F.kll_sketch_get_quantile_double(f"s{i}", F.array(*[F.lit(float(p)) for p in wanted[n][1]])).alias(f"q{i}")
            for i, n in enumerate(names)
        ]
    ).first()
    return {n: list(row[i]) for i, n in enumerate(names)}


def _merged_moments(parts: list) -> dict:
    """Moments of a column from those of its shards, in the order of the shards."""
    n, mean, spread, total = 0, 0.0, 0.0, 0.0
    for p in parts:
        if p["n"]:
            step = p["total"] / p["n"] - mean
            spread += p["n"] * p["spread"] + step * step * n * p["n"] / (n + p["n"])
            n, total = n + p["n"], total + p["total"]
            mean += step * p["n"] / n
    rows = sum(p["n_rows"] for p in parts)
    ends = [p for p in parts if p["n"]]
    return {
        "count": n,
        "nulls": rows - n,
        "sum": total if n else None,
        "mean": total / n if n else None,
        "var_pop": spread / n if n else None,
        "std_pop": math.sqrt(spread / n) if n else None,
        "var": spread / (n - 1) if n > 1 else None,
        "std": math.sqrt(spread / (n - 1)) if n > 1 else None,
        "min": min((p["least"] for p in ends), default=None),
        "max": max((p["most"] for p in ends), default=None),
    }


def summarise(df: DataFrame, columns: Sequence[str], probs: Sequence[float], slack: float = SKETCH_SLACK) -> Summary:
    """Moments and sketched quantiles of numeric columns in one scan.

    Around each probability two values of the sketch are given, or one if there
    is no ``slack``. At most ``SKETCH_SHARDS`` partial moments a column come to
    the driver; sketches are merged in two steps, so no task merges one for
    every input split.
    """
    columns, out = list(columns), Summary({}, {})
    asked = [[max(0.0, p - slack), min(1.0, p + slack)] if slack else [p] for p in probs]
    flat = F.array(*[F.lit(float(p)) for pair in asked for p in pair])
    for start in range(0, len(columns), COLUMNS_PER_SCAN):
        batch = columns[start : start + COLUMNS_PER_SCAN]
        aggregates = []
        for i, c in enumerate(batch):
            v = measure(df, c)
            whole = [F.count(v).alias("n"), F.count(F.lit(1)).alias("n_rows"), F.sum(v).alias("total"), F.var_pop(v).alias("spread"), F.min(v).alias("least"), F.max(v).alias("most")]
            aggregates += [F.struct(*whole).alias(f"m{i}"), F.kll_sketch_agg_double(v, F.lit(SKETCH_SIZE)).alias(f"s{i}")]
        parts = df.groupBy(_shard()).agg(*aggregates)
        merged = []
        for i in range(len(batch)):
            merged += [F.collect_list(F.struct("shard", f"m{i}")).alias(f"m{i}"), F.kll_merge_agg_double(f"s{i}").alias(f"s{i}"), F.sum(f"m{i}.n").alias(f"n{i}")]
        quantile = [F.when(F.col(f"n{i}") > 0, F.kll_sketch_get_quantile_double(f"s{i}", flat)).alias(f"q{i}") for i in range(len(batch))]
        row = parts.agg(*merged).select(*[f"m{i}" for i in range(len(batch))], *(quantile if probs else [])).first()
        for i, c in enumerate(batch):
            found = sorted(row[f"m{i}"], key=lambda x: x["shard"])
            out.moments[c] = _merged_moments([x[f"m{i}"] for x in found])
            values = list(row[f"q{i}"] or []) if probs else []
            size = len(asked[0]) if asked else 1
            out.around[c] = [values[k : k + size] for k in range(0, len(values), size)]
    return out


def order_statistics(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    interpolate: bool = True,
    small_bracket: int = SMALL_BRACKET,
    known: Summary | None = None,
) -> dict[str, list[float | None]]:
    """Exact quantiles of numeric columns as fitted constants.

    With ``interpolate`` the position is ``p * (n - 1)`` between neighbouring
    values; without it the value at rank ``floor(n * p)`` is returned. Nulls and
    non-finite values are left out; a column without values gives ``None``.
    ``known`` is the :func:`summarise` of the same columns and probabilities,
    where the caller has it; then one scan less is needed.
    """
    columns, probs = list(columns), list(probs)
    if not columns or not probs:
        return {c: [] for c in columns}
    known = known or summarise(df, columns, probs)
    data = df.select(*[measure(df, c).alias(c) for c in columns])
    counts = {c: known.moments[c]["count"] for c in columns}
    filled = [c for c in columns if counts[c]]
    result: dict[str, list[float | None]] = {c: [None] * len(probs) for c in columns}
    places = {(c, p): _ranks(counts[c], p, interpolate) for c in filled for p in probs}
    targets = {
        (c, p, rank): _Target(c, p, rank, counts[c]) for (c, p), place in places.items() for rank in set(place[:2])
    }
    brackets = {(c, p): known.around[c][k] for c in filled for k, p in enumerate(probs)}
    _search(data, list(targets.values()), brackets, small_bracket)
    for (c, p), (k0, k1, weight) in places.items():
        lo, hi = targets[c, p, k0].answer, targets[c, p, k1].answer
        result[c][probs.index(p)] = lo + (hi - lo) * weight
    return result


def _search(data: DataFrame, targets: list[_Target], brackets: dict[tuple, list[float]], small_bracket: int) -> None:
    """Answer all targets, a round at a time.

    A round has two values around each rank, at first those of the caller, then
    those of a new sketch of the interval; an interval that is small enough needs
    none. One scan looks at the regions they cut. A rank that lands on one of the
    values, or in a region of which the values were counted, is answered;
    otherwise the region that holds it, without its ends, is the next interval.
    Heavily repeated values therefore drop out, and an interval always shrinks.
    """
    while left := [t for t in targets if t.answer is None]:
        large = [t for t in left if t.inside > small_bracket]
        if brackets is None:
            brackets = _resketched(data, large)
        cuts: dict[tuple, set[float]] = {t.interval: set() for t in left}
        for t in large:
            cuts[t.interval].update(brackets[t.column, t.prob])
        lists = {interval: sorted(values) for interval, values in cuts.items()}
        taken: dict[tuple, set[int]] = {interval: set() if values else {0} for interval, values in lists.items()}
        for t in large:
            if t.inside * 2 * SKETCH_SLACK <= small_bracket:
                ends, values = brackets[t.column, t.prob], lists[t.interval]
                taken[t.interval].update(2 * j for j in range(values.index(ends[0]) + 1, values.index(ends[-1]) + 1))
        _look(data, left, lists, taken)
        brackets = None


def _resketched(data: DataFrame, targets: list[_Target]) -> dict[tuple, list[float]]:
    """Two values around the rank of each target, by column and probability."""
    asked: dict[tuple, tuple[Column, list[float]]] = {}
    place: dict[tuple, tuple[tuple, int]] = {}
    for t in targets:
        if (t.column, t.prob) not in place:
            _, probs = asked.setdefault(t.interval, (F.when(_within(t), as_column(t.column)), []))
            place[t.column, t.prob] = t.interval, len(probs)
            at = (t.rank - t.below) / t.inside
            probs += [max(0.0, at - SKETCH_SLACK), min(1.0, at + SKETCH_SLACK)]
    found = _sketch_quantiles(data, asked) if asked else {}
    return {key: found[interval][k : k + 2] for key, (interval, k) in place.items()}


def _cells(data: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The given columns as rows ``(at, value)``; ``at`` is the position in the list."""
    return data.select(F.posexplode(F.array(*[as_column(c) for c in columns])).alias("at", "value"))


def _per_cell(constants: Sequence[float]) -> Column:
    """The constant that belongs to a cell's column."""
    return F.array(*[F.lit(float(c)) for c in constants])[F.col("at")]


def _look(data: DataFrame, targets: list[_Target], cuts: dict[tuple, list[float]], taken: dict[tuple, set[int]]) -> None:
    """Move each target into the region that holds its rank, or answer it; one scan for all.

    Region ``2 j`` of an interval lies between cut ``j - 1`` and cut ``j``; region ``2 j + 1`` is cut ``j`` itself. Rows
    are counted by region, in the ``taken`` regions by value. Running counts over regions and values then give the place
    of every rank. They go over a row for each region and each value of a taken one.
    """
    # one row per cell, so the generated code does not grow with the number of columns
    names, inf = list(cuts), float("inf")
    cells = _cells(data, [column for column, _, _ in names])
    low, high = _per_cell([n[1] for n in names]), _per_cell([n[2] for n in names])
    value, most = F.col("value"), max(len(values) for values in cuts.values())
    region = F.lit(0)
    for j in range(most):
        cut = _per_cell([cuts[n][j] if j < len(cuts[n]) else inf for n in names])
        region = region + (value > cut).cast("int") + (value >= cut).cast("int")
    kept = F.array(*[F.array(*[F.lit(r % 2 == 1 or r in taken[n]) for r in range(2 * most + 1)]) for n in names])
    cells = cells.where((value > low) & (value < high)).select("at", region.alias("region"), "value")
    cells = cells.select("at", "region", F.when(kept[F.col("at")][F.col("region")], value).alias("value"))
    # heavy ties collapse in the map-side half of this count
    counts = cells.groupBy("at", "region", "value").count()
    running = "sum(count) over (partition by at order by region, value rows unbounded preceding)"
    ranked = counts.selectExpr("at", "region", "value", "count", f"{running} as upto")
    here = F.struct("region", "value", "count", "upto")
    picked = ranked.agg(
        *[F.min(F.when((F.col("at") == names.index(t.interval)) & (F.col("upto") > t.rank - t.below), here)) for t in targets]
    ).first()
    for t, found in zip(targets, picked):
        if found["value"] is not None:
            t.answer = found["value"]
            continue
        at, values = found["region"] // 2, cuts[t.interval]
        low_end, high_end = values[at - 1] if at else t.low, values[at] if at < len(values) else t.high
        t.low, t.high, t.below, t.inside = low_end, high_end, t.below + found["upto"] - found["count"], found["count"]


def quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], exact: bool = True
) -> dict[str, list[float | None]]:
    """Quantiles by linear interpolation; ``exact=False`` settles for the sketch."""
    return moments_and_quantiles(df, columns, probs, exact)[1]


def moments_and_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], exact: bool = True
) -> tuple[dict[str, dict], dict[str, list[float | None]]]:
    """Moments, and quantiles by linear interpolation, that share the first scan."""
    columns, probs = list(columns), list(probs)
    known = summarise(df, columns, probs, SKETCH_SLACK if exact else 0.0)
    if exact:
        return known.moments, order_statistics(df, columns, probs, known=known)
    return known.moments, {c: [v[0] for v in known.around[c]] or [None] * len(probs) for c in columns}
