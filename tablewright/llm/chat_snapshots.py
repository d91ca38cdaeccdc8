"""Chat formatting: logged snapshots of growing conversations collapsed to the maximal ones, then rendered.

A log that stores a conversation after every turn holds each one many times, every copy a prefix of the next. A rolling
hash over the turns names every prefix. A conversation whose whole hash is a proper prefix of another one goes by an
anti-join; of equal conversations the smallest id stays. Only what is left is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.llm.common import table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _plain(turns: DataFrame) -> DataFrame:
    return turns.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """Every prefix of every conversation: ``(conv_id, k, h1, h2, grows)``; ``grows``: more turns follow.

    A turn's digest is mixed with its place and the mixtures are added up by exclusive or, twice with different seeds:
    128 bits name the prefix. A conversation is summed as a running window, which streams and spills.
    """
    digests = (
        _plain(turns)
        .select(
            "conv_id",
            "turn",
            F.xxhash64(F.lit(1), F.length("role"), "role", "text").alias("d1"),
            F.xxhash64(F.lit(2), F.length("role"), "role", "text").alias("d2"),
        )
        .distinct()
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "d1", "d2")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        digests.withColumn("k", F.row_number().over(order).cast("long"))
        .withColumn("grows", F.lead("d1").over(order).isNotNull())
        .select(
            "conv_id",
            "k",
            F.bit_xor(F.xxhash64(F.lit(3), "k", "d1", "d2")).over(upto).alias("h1"),
            F.bit_xor(F.xxhash64(F.lit(4), "k", "d2", "d1")).over(upto).alias("h2"),
            "grows",
        )
    )


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """Conversations that are no prefix of a longer one: ``(conv_id, n_turns, n_copies)``, equal ones by their smallest id."""
    prefixes = prefix_hashes(turns)
    key = ["k", "h1", "h2"]
    whole = prefixes.where("NOT grows").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    inner = prefixes.where("grows").select(*key).distinct()
    return whole.join(inner, key, "left_anti").select("conv_id", F.col("k").alias("n_turns"), "n_copies")


def _turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(CLOSE))


def render_conversations(turns: DataFrame) -> DataFrame:
    """One row per maximal conversation: ``(conv_id, n_turns, n_copies, rendered)``.

    Turns are ordered by turn number, ties by role and text; a null number comes first. A turn that is logged twice in
    one conversation (equal number, role and text) counts once. A null role or text reads as empty. Rows without a
    conversation id belong to none and are left out. Other columns are ignored; an empty table gives no rows.
    """
    kept = maximal_conversations(turns)
    said = _plain(turns).join(kept.select("conv_id"), "conv_id", "left_semi")
    told = said.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))), lambda t: _turn(t["role"], t["text"])), "").alias("rendered")
    )
    return kept.join(told, "conv_id").select("conv_id", "n_turns", "n_copies", "rendered")


def op4_chat_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, collapsed and rendered."""
    return render_conversations(table(spark, folder, "conversations"))


OP4_SQL = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce("text", '') AS said FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({{'role': role, 'said': said}} ORDER BY turn NULLS FIRST, role, said) AS turns,
    string_agg('{OPEN}' || role || chr(10) || said || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, said) AS rendered
  FROM t GROUP BY conv_id),
w AS (SELECT turns, min(conv_id) AS conv_id, count(*) AS n_copies, min(rendered) AS rendered FROM c GROUP BY turns)
SELECT a.conv_id, len(a.turns) AS n_turns, a.n_copies, a.rendered FROM w a
WHERE NOT EXISTS (SELECT 1 FROM w b WHERE b.turns[1] = a.turns[1] AND len(b.turns) > len(a.turns) AND b.turns[:len(a.turns)] = a.turns)
"""
