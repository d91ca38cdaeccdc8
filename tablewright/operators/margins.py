"""Maximum-margin machines on random cosine features that are made anew in every pass.

A row has a hundred cosine features for the few numbers it comes with, so neither they nor blocks of them are kept.
A pass maps the rows again and returns, for each task, the sums of hinge losses and gradients at all points that the
machines ask for. The search is the one of ``LinearSVC``: OWL-QN without an L1 term over features scaled to spread one
and virtually centred, with the same backtracking and the same rules to stop.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Generator, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

# Fixed values of the search.
MEMORY = 10  # steps that shape the next direction
LOSSES = 20  # losses that must lie together
TRIALS, SHRINK, SHRINK_FIRST, GROW = 20, 0.5, 0.1, 2.1
ARMIJO, WOLFE = 1e-4, 0.9
LEAST_STEP, MOST_STEP, LEAST_GRADIENT = 1e-10, 1e10, 1e-8
NO_SPREAD = 1e-12  # of a cosine feature; less is rounding

AT_ONCE = 4  # machines that share a pass
BLOCK_ROWS, BLOCK_NUMBERS = 4096, 1 << 18  # of a block of rows, at most
CHUNK_ROWS = 1024  # rows whose cosine features a task holds
SUM_ROWS = 1000  # tasks whose sums the driver takes; more are added up by tasks first

Points = list[np.ndarray]
Search = Generator[Points, list[tuple[float, np.ndarray]], np.ndarray]


class SearchFailed(Exception):
    """No usable direction or step."""


def cosine_weights(gamma: float, width: int, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Random frequencies and shifts of ``size`` cosine features of ``width`` inputs."""
    rng = np.random.default_rng(seed)
    return rng.normal(0.0, np.sqrt(2.0 * gamma), (width, size)), rng.uniform(0.0, 2.0 * np.pi, size)


def cosines(values: np.ndarray, weights: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Cosine features of rows."""
    mapped = values @ weights
    mapped += shift
    np.cos(mapped, out=mapped)
    mapped *= np.sqrt(2.0 / len(shift))
    return mapped


def _direction(grad: np.ndarray, pairs: Sequence[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Downhill direction by the latest steps and changes of the gradient, newest first."""
    way, scale, shares = grad.copy(), 1.0, []
    with np.errstate(all="ignore"):
        if pairs:
            step, change = pairs[0]
            if not step @ change >= 0:
                raise SearchFailed
            scale = (step @ change) / (change @ change)
        for step, change in pairs:
            shares.append((step @ way) / (step @ change))
            if np.isnan(shares[-1]):
                raise SearchFailed
            way -= shares[-1] * change
        way *= scale
        for (step, change), share in zip(reversed(pairs), reversed(shares)):
            way += (share - (change @ way) / (step @ change)) * step
    return np.where(way * grad > 0, -way, 0.0)


def search(size: int, iterations: int, tolerance: float) -> Search:
    """Yields points, is sent their losses and gradients, and returns the last point.

    With each point it asks for the two that the line search may want next, as they cost a pass hardly more.
    """
    x = np.zeros(size)
    [(value, grad)] = yield [x]
    start, losses, pairs, failed, done = value, [math.inf], [], False, 0
    while done < iterations and np.linalg.norm(grad) > max(tolerance * abs(value), LEAST_GRADIENT):
        if len(losses) > 1 and abs(value - max(losses)) <= tolerance * abs(start):
            break
        orthant = np.where(x != 0, np.sign(x), np.sign(-grad))
        known: dict[float, tuple[float, np.ndarray]] = {}
        shrink = SHRINK if done else SHRINK_FIRST

        def reach(alpha: float) -> np.ndarray:
            to = x + alpha * way
            return np.where(np.sign(to) == orthant, to, 0.0)

        def look(alpha: float) -> Generator[Points, list[tuple[float, np.ndarray]], tuple[float, np.ndarray]]:
            if alpha not in known:
                ahead = [alpha, alpha * GROW, alpha * shrink]
                known.update(zip(ahead, (yield [reach(a) for a in ahead])))
            return known[alpha]

        try:
            way = _direction(grad, pairs)
            slope, alpha, at = way @ grad, 1.0 if done else 0.5 / np.linalg.norm(grad), value
            for trial in range(TRIALS):
                # the first trial counts with the loss before it, as in Breeze, so it is shrunk unseen
                if at > value + alpha * slope * ARMIJO:
                    factor = shrink
                else:
                    turn = (yield from look(alpha))[1] @ way
                    factor = GROW if turn < WOLFE * slope else shrink if turn > -WOLFE * slope else 1.0
                if factor == 1.0:
                    break
                if not LEAST_STEP <= alpha * factor <= MOST_STEP:
                    raise SearchFailed
                if trial < TRIALS - 1:
                    alpha *= factor
                    at = (yield from look(alpha))[0]
            to, (value, grad_to) = reach(alpha), (yield from look(alpha))
        except SearchFailed:
            if failed:
                break
            failed, pairs = True, []
            continue
        pairs = [(to - x, grad_to - grad), *pairs][:MEMORY]
        x, grad, failed, done = to, grad_to, False, done + 1
        losses = [*losses, value][-LOSSES:]
    return x


def pack(data: DataFrame, width: int) -> DataFrame:
    """Columns ``label`` (int) and ``cells`` (array of ``width`` doubles) as blocks of rows in bytes, which passes read fast."""
    most = max(1, min(BLOCK_ROWS, BLOCK_NUMBERS // width))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column("label").to_numpy()
            values = batch.column("cells").flatten().to_numpy(zero_copy_only=False).reshape(len(labels), width)
            for at in range(0, len(labels), most):
                block = labels[at : at + most].tobytes(), values[at : at + most].tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in block], names=["labels", "cells"])

    return data.select("label", "cells").mapInArrow(blocks, "labels binary, cells binary")


def _chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Labels and features of a few rows at a time."""
    for batch in batches:
        for labels, cells in zip(batch.column("labels"), batch.column("cells")):
            codes = np.frombuffer(labels.as_buffer(), np.int32)
            values = np.frombuffer(cells.as_buffer(), np.float64).reshape(len(codes), width)
            for at in range(0, len(codes), CHUNK_ROWS):
                yield codes[at : at + CHUNK_ROWS], values[at : at + CHUNK_ROWS]


_SUMS = "task int, sums array<double>"
_Add = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _one(total: np.ndarray) -> pa.RecordBatch:
    task = TaskContext.get().partitionId()
    return pa.RecordBatch.from_arrays(
        [pa.array([task], pa.int32()), pa.array([total], pa.list_(pa.float64()))], names=["task", "sums"]
    )


def _rows(column: pa.Array | pa.ChunkedArray) -> Iterator[np.ndarray]:
    return (np.asarray(row.values) for row in column)


def _total(parts: DataFrame, tasks: int, add: _Add) -> np.ndarray:
    """One row of sums from each task, added up."""
    if tasks > SUM_ROWS:

        def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = [row for batch in batches for row in _rows(batch.column("sums"))]
            if rows:
                yield _one(reduce(add, rows))

        parts = parts.repartition(math.isqrt(tasks), "task").sortWithinPartitions("task").mapInArrow(some, _SUMS)
    return reduce(add, _rows(parts.toArrow().column("sums")))


def _add_moments(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number, means and sums of squares about the means of two parts together."""
    if not a[0] or not b[0]:
        return a if a[0] else b
    n, half = a[0] + b[0], len(a) // 2 + 1
    apart = b[1:half] - a[1:half]
    means, squares = a[1:half] + apart * (b[0] / n), a[half:] + b[half:] + apart**2 * (a[0] * b[0] / n)
    return np.concatenate([[n], means, squares])


def moments(data: DataFrame, tasks: int, weights: np.ndarray, shift: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Number of rows, means and sample deviations of their cosine features."""
    width, size = weights.shape

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + 2 * size)
        for _, values in _chunks(batches, width):
            mapped = cosines(values, weights, shift)
            off = mapped - mapped[0]  # equal rows have no spread at all
            mean = off.mean(axis=0)
            some = np.concatenate([[len(mapped)], mapped[0] + mean, ((off - mean) ** 2).sum(axis=0)])
            total = _add_moments(total, some)
        yield _one(total)

    total = _total(data.mapInArrow(part, _SUMS), tasks, _add_moments)
    spread = np.sqrt(total[1 + size :] / max(1.0, total[0] - 1))
    return total[0], total[1 : 1 + size], np.where(spread > NO_SPREAD, spread, 0.0)


def hinge_sums(
    data: DataFrame,
    tasks: int,
    weights: np.ndarray,
    shift: np.ndarray,
    codes: np.ndarray,
    linear: np.ndarray,
    offsets: np.ndarray,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums over all rows, for a machine in each column of ``linear``: hinge losses, and gradients by intercept and weights."""
    (width, size), n = weights.shape, len(codes)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        losses, pulls, grads = np.zeros(n), np.zeros(n), np.zeros((size, n))
        for labels, values in _chunks(batches, width):
            mapped = cosines(values, weights, shift)
            side = np.where(labels[:, None] == codes, 1.0, -1.0)
            short = 1.0 - side * (mapped @ linear + offsets)
            losses += np.maximum(short, 0.0).sum(axis=0)
            pull = np.where(short > 0, -side, 0.0)
            pulls += pull.sum(axis=0)
            grads += mapped.T @ pull
        yield _one(np.concatenate([losses, pulls, grads.ravel()]))

    total = _total(data.mapInArrow(part, _SUMS), tasks, np.add)
    return total[:n], total[n : 2 * n], total[2 * n :].reshape(size, n)


def fit_machines(
    data: DataFrame,
    codes: Sequence[int],
    weights: np.ndarray,
    shift: np.ndarray,
    penalty: float,
    iterations: int,
    tolerance: float,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights, one row per class code, and intercepts of machines that tell a class from all others.

    ``data`` comes from :func:`pack` and is read once in each pass, which serves up to :data:`AT_ONCE` machines.
    """
    tasks = data.rdd.getNumPartitions()
    rows, means, spread = moments(data, tasks, weights, shift)
    size = len(shift)
    scale = np.divide(1.0, spread, out=np.zeros(size), where=spread != 0)
    centre = means * scale

    def evaluate(asked: list[tuple[int, np.ndarray]]) -> list[tuple[float, np.ndarray]]:
        points = np.column_stack([p for _, p in asked])
        linear, offsets = points[:size] * scale[:, None], points[size] - centre @ points[:size]
        losses, pulls, grads = hinge_sums(data, tasks, weights, shift, np.array([c for c, _ in asked]), linear, offsets)
        shrunk = points[:size] * (scale**2)[:, None]
        losses = losses / rows + 0.5 * penalty * (points[:size] * shrunk).sum(axis=0)
        grads = (grads * scale[:, None] - np.outer(centre, pulls)) / rows + penalty * shrunk
        return [(float(losses[i]), np.append(grads[:, i], pulls[i] / rows)) for i in range(len(asked))]

    found: dict[int, np.ndarray] = {}
    for at in range(0, len(codes), AT_ONCE):
        searches = {c: search(size + 1, iterations, tolerance) for c in codes[at : at + AT_ONCE]}
        wanted = {c: next(s) for c, s in searches.items()}
        while wanted:
            told = iter(evaluate([(c, p) for c, points in wanted.items() for p in points]))
            for c, points in list(wanted.items()):
                try:
                    wanted[c] = searches[c].send([next(told) for _ in points])
                except StopIteration as end:
                    found[c] = end.value
                    del wanted[c]
    points = np.array([found[c] for c in codes])
    return points[:, :size] * scale, points[:, size] - points[:, :size] @ centre


def margins(data: DataFrame, weights: np.ndarray, shift: np.ndarray, slopes: np.ndarray, intercepts: np.ndarray) -> DataFrame:
    """Columns ``label`` and ``m``, the margins of machines over rows of :func:`pack`."""
    width = len(weights)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for labels, values in _chunks(batches, width):
            found = cosines(values, weights, shift) @ slopes.T + intercepts
            ends = pa.array(np.arange(0, found.size + 1, len(intercepts)), pa.int32())
            m = pa.ListArray.from_arrays(ends, pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(labels), m], names=["label", "m"])

    return data.mapInArrow(part, "label int, m array<double>")
