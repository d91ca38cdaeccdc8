"""Filter interaction audit on sorted posting lists.

Each filter keeps, for each part of the table and each range of row numbers, the sorted list of the rows that fail it.
What a filter removes after others is the difference of its list and the union of theirs. Unions and differences are
merges of sorted lists that gallop: a stretch of the shorter list doubles its reach in the longer one until it is past
the stretch, and only that window is searched. Sizes are summed over the ranges, so no list of a whole part exists.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from hashlib import sha256
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.llm.common import table, written

RANGE_BITS = 17  # a range holds this many row numbers at most, as a power of two
STRETCH = 256
HOT_COPIES, HOT_TEXTS = 1_000, 100_000
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 50, 65, 5
CAPITALS, MARKS = bytes(range(65, 91)), b"#$%&*|"


def positions(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Where each id of one sorted list would stand in another, by galloping."""
    out, at = np.empty(len(short), np.int64), 0
    for i in range(0, len(short), STRETCH):
        ids, reach = short[i : i + STRETCH], STRETCH
        while at + reach < len(long) and long[at + reach] < ids[-1]:
            reach *= 2
        out[i : i + len(ids)] = at + np.searchsorted(long[at : at + reach + 1], ids)
        at = int(out[i + len(ids) - 1])
    return out


def held(ids: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Whether each id is in the other list; both are sorted and hold no id twice."""
    if not len(ids) or not len(among):
        return np.zeros(len(ids), bool)
    if len(ids) <= len(among):
        at = positions(ids, among)
        return (at < len(among)) & (among[np.minimum(at, len(among) - 1)] == ids)
    at, out = positions(among, ids), np.zeros(len(ids), bool)
    inside = at < len(ids)
    out[at[inside]] = ids[at[inside]] == among[inside]
    return out


def union(lists: Sequence[np.ndarray]) -> np.ndarray:
    """Sorted union of sorted lists, the two shortest merged first."""
    lists = sorted(lists, key=len)
    while len(lists) > 1:
        short, long, *rest = lists
        new = short[~held(short, long)]
        lists = sorted([np.insert(long, positions(new, long), new), *rest], key=len)
    return lists[0] if lists else np.empty(0, np.int64)


def posting_lists(facts: DataFrame, filters: Sequence[str], marks: Sequence[str] = (), range_bits: int = RANGE_BITS) -> DataFrame:
    """``(part, range, name, ids)``: the sorted rows of each range that fail a filter or, of those that fail any, bear a mark.

    ``facts`` has a distinct long ``row``, ``part``, and a boolean column for each filter and mark; null counts as false.
    """
    fails = [F.coalesce(F.col(f), F.lit(False)) for f in filters]
    any_fails = F.array_contains(F.array(*fails), True)
    names = F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in [*filters, *marks]]))
    told = facts.where(any_fails).select("part", F.shiftright("row", range_bits).alias("range"), "row", F.explode(names).alias("name"))
    return told.groupBy("part", "range", "name").agg(F.array_sort(F.collect_list("row")).alias("ids"))


def _interactions(filters: Sequence[str], marks: Sequence[str]):
    def run(lists: pa.Table) -> pa.Table:
        of = {n: np.asarray(ids.values.to_numpy()) for n, ids in zip(lists["name"].to_pylist(), lists["ids"].combine_chunks())}
        none, out = np.empty(0, np.int64), []
        unions = {0: none}
        for mask in range(1, 1 << len(filters)):
            top = mask.bit_length() - 1
            unions[mask] = union([unions[mask ^ 1 << top], of.get(filters[top], none)])
        for i, f in enumerate(filters):
            own = of.get(f, none)
            for seen in range(1 << len(filters)):
                if not seen >> i & 1:
                    here = own[~held(own, unions[seen])]
                    out.append((seen, i, len(here), len(unions[seen | 1 << i]), *(int(held(here, of.get(m, none)).sum()) for m in marks)))
        columns = [pa.array(c, pa.int64()) for c in zip(*out)]
        part = pa.array([lists["part"][0].as_py()] * len(out), pa.string())
        return pa.table([part, *columns], ["part", "seen", "filter", "removed", "covered", *marks])

    return run


def interactions(lists: DataFrame, filters: Sequence[str], marks: Sequence[str] = ()) -> DataFrame:
    """``(part, seen, filter, removed, covered, marks...)`` summed over all ranges, for each filter and each set of others.

    ``seen`` has a bit for each filter of the set, ``filter`` is a number. ``removed`` counts the rows that fail the
    filter and none of the set, ``covered`` those that fail any of them, a mark's column the removed rows that bear it.
    """
    shape = "part string, seen long, filter long, removed long, covered long" + "".join(f", {m} long" for m in marks)
    each = lists.groupBy("part", "range").applyInArrow(_interactions(filters, marks), shape)
    return each.groupBy("part", "seen", "filter").agg(*[F.sum(c).alias(c) for c in ("removed", "covered", *marks)])


def audit(facts: DataFrame, filters: Sequence[str], marks: Mapping[str, str], range_bits: int = RANGE_BITS) -> DataFrame:
    """One row per part, order of the filters and step, zeros included.

    ``facts`` is as for :func:`posting_lists` and must be written, as it is read twice; ``marks`` gives for each mark the
    name of its column of lost rows. ``redundant`` rows fail the step's filter but went earlier, ``unique_fails`` fail it
    alone, ``shapley`` sums what the filter removes over all orders. Parts without rows do not occur: an empty table
    gives no rows. Names of filters must be letters or digits, one each.
    """
    n = len(filters)
    lists = posting_lists(facts, filters, list(marks), range_bits)
    found = interactions(lists, filters, list(marks))
    parts = facts.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    sets = [(seen, i) for i in range(n) for seen in range(1 << n) if not seen >> i & 1]
    every = parts.select("part", "rows", F.inline(F.array(*[F.struct(F.lit(s).cast("long").alias("seen"), F.lit(i).cast("long").alias("filter")) for s, i in sets])))
    counts = ["removed", "covered", *marks]
    every = every.join(found, ["part", "seen", "filter"], "left").select("part", "rows", "seen", "filter", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])
    whole, bits = Window.partitionBy("part", "filter"), F.bit_count("seen")
    orders_with = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), bits + 1)
    every = every.select(
        "*",
        F.max(F.when(bits == 0, F.col("removed"))).over(whole).alias("fails"),
        F.max(F.when(bits == n - 1, F.col("removed"))).over(whole).alias("unique_fails"),
        F.sum(F.col("removed") * orders_with).over(whole).alias("shapley"),
    )
    steps = [("".join(filters[i] for i in p), k + 1, sum(1 << i for i in p[:k]), p[k]) for p in permutations(range(n)) for k in range(n)]
    orders = facts.sparkSession.createDataFrame(steps, "filter_order string, step int, seen long, filter long")
    out = every.join(F.broadcast(orders), ["seen", "filter"])  # as many rows as there are orders and steps
    return out.select(
        "part",
        "filter_order",
        "step",
        (F.col("rows") - F.col("covered")).alias("kept"),
        "removed",
        (F.col("fails") - F.col("removed")).alias("redundant"),
        "unique_fails",
        *[F.col(m).alias(lost) for m, lost in marks.items()],
        "shapley",
    )


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            out: tuple[list, ...] = ([], [], [], [], [])
            for text in part.column(2).to_pylist():
                raw = (text or "").encode()
                words = raw.split()
                points = len(text or "")
                out[0].append(len(words) < MIN_WORDS)
                out[1].append(100 * len(set(words)) < DISTINCT_PERCENT * len(words))
                out[2].append(100 * (len(raw) - len(raw.translate(None, CAPITALS))) > CAPITAL_PERCENT * points)
                out[3].append(len(raw) > len(raw.translate(None, MARKS)))
                out[4].append(sha256(raw).digest())
            columns = [*(pa.array(c, pa.bool_()) for c in out[:4]), pa.array(out[4], pa.binary())]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], ["doc_id", "part", "A", "B", "C", "D", "text"])


def judged(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``(row, part, A, B, C, D, E, good, toxic)`` of every document; a written table.

    A: too few words; B: too few distinct words; C: too many capitals; D: a special character; E: the text is that of a
    document with a smaller id. Null texts and sources count as empty. Rows are judged one by one, also those that share
    an id; a row without an id never fails E and no row fails it because of one. A row is good or toxic if any label of
    its id says so. Other columns are ignored.
    """
    rows = documents.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), "text")
    kind = documents.schema["doc_id"].dataType.simpleString()
    told = rows.mapInArrow(_judged, f"doc_id {kind}, part string, A boolean, B boolean, C boolean, D boolean, text binary")
    told = written(told.withColumn("row", F.monotonically_increasing_id()), "judged")
    first = written(told.groupBy("text").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated-texts")
    # texts with very many copies are broadcast, of which there are HOT_TEXTS at most, so that no task gets all their rows
    many = max(HOT_COPIES, told.count() // HOT_TEXTS)
    hot = F.broadcast(first.where(F.col("n") > many).select("text", "first"))
    rest = first.where(F.col("n") <= many).select("text", "first")
    told = told.join(hot, "text").unionByName(told.join(hot, "text", "left_anti").join(rest, "text", "left"))
    marks = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    out = told.join(marks, "doc_id", "left")
    later: Column = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return written(out.select("row", "part", "A", "B", "C", "D", later.alias("E"), "good", "toxic"), "audit-facts")


def op12_interaction_audit(spark: SparkSession, folder: str) -> DataFrame:
    """All documents, each source a part, under five filters in every order."""
    facts = judged(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return audit(facts, "ABCDE", {"good": "good_lost", "toxic": "toxic_lost"})


def _sql() -> str:
    """The same report, row by row: each failing row goes at the first of its filters in each order."""
    orders = ", ".join(f"('{''.join(p)}')" for p in permutations("ABCDE"))
    return f"""
    WITH words AS (
      SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
             regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    firsts AS (SELECT t, min(doc_id) AS first FROM words GROUP BY t),
    marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
    facts AS (
      SELECT words.part,
             CASE WHEN len(w) < {MIN_WORDS} THEN 'A' ELSE '' END
             || CASE WHEN 100 * len(list_distinct(w)) < {DISTINCT_PERCENT} * len(w) THEN 'B' ELSE '' END
             || CASE WHEN 100 * length(regexp_replace(words.t, '[^A-Z]', '', 'g')) > {CAPITAL_PERCENT} * length(words.t) THEN 'C' ELSE '' END
             || CASE WHEN regexp_matches(words.t, '[#$%&*|]') THEN 'D' ELSE '' END
             || CASE WHEN words.doc_id > first THEN 'E' ELSE '' END AS fails,
             coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
      FROM words JOIN firsts ON words.t = firsts.t LEFT JOIN marks ON words.doc_id = marks.doc_id),
    groups AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM facts GROUP BY part, fails),
    orders AS (SELECT * FROM (VALUES {orders}) AS o(filter_order)),
    steps AS (SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, CAST(step AS INTEGER), 1) AS f,
                     substr(filter_order, 1, CAST(step AS INTEGER) - 1) AS seen FROM orders, range(1, 6) AS r(step)),
    counted AS (
      SELECT part, filter_order, step, f,
             sum(CASE WHEN translate(fails, seen || f, '') = fails THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN instr(fails, f) > 0 AND translate(fails, seen, '') = fails THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN instr(fails, f) > 0 AND translate(fails, seen, '') <> fails THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN instr(fails, f) > 0 AND translate(fails, seen, '') = fails THEN good ELSE 0 END) AS good_lost,
             sum(CASE WHEN instr(fails, f) > 0 AND translate(fails, seen, '') = fails THEN toxic ELSE 0 END) AS toxic_lost
      FROM groups, steps GROUP BY part, filter_order, step, f)
    SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
           CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
           CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
           CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
    FROM counted"""


OP12_SQL = _sql()
