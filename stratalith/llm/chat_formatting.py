"""Collapse of cumulative chat snapshots, and rendering, in DataFrame functions alone.

A service logs a conversation again whenever it grows, so that logged conversations
are prefixes of others.  The prefix of i turns has as its hash the XOR of
hashes of (place, role, text) of its turns: a rolling hash, kept by a running
aggregate, that depends on order through the place.  With two such hashes (128
bits) conversations that equal a proper prefix of another go by an anti-join;
of equal ones the smallest conv_id stays.  Prefixes are made distinct before they
are shuffled, so a common first turn is one row for each map task.

Turns are in order of turn, null first, then of role and text, so repeated turn
numbers have a defined order; null role or text counts as empty; rows with a null
conv_id are left out; further columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

START, STOP = "<|im_start|>", "<|im_end|>"


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, i (place from 1), role, text, p1, p2 (hashes of the prefix that ends here)."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    t = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", blank("role").alias("role"), blank("text").alias("text"))
    w = W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    t = t.withColumn("i", F.row_number().over(w))
    t = t.withColumn("h1", F.xxhash64("i", "role", "text")).withColumn("h2", F.xxhash64(F.lit("second"), "text", "i", "role"))
    so_far = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    return t.select("conv_id", "i", "role", "text", F.bit_xor("h1").over(so_far).alias("p1"), F.bit_xor("h2").over(so_far).alias("p2"))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns and n_copies of the conversations that no other one contains as a prefix."""
    ends = turns.groupBy("conv_id").agg(F.max("i").alias("i"), F.max_by("p1", "i").alias("p1"), F.max_by("p2", "i").alias("p2"))
    distinct = ends.groupBy("i", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    # a prefix is proper if its conversation has a next turn; every turn but the first names the prefix before it
    before = W.partitionBy("conv_id").orderBy("i")
    proper = turns.select("conv_id", F.lag("i").over(before).alias("i"), F.lag("p1").over(before).alias("p1"), F.lag("p2").over(before).alias("p2"))
    proper = proper.filter("i is not null").select("i", "p1", "p2").distinct()
    return distinct.join(proper, ["i", "p1", "p2"], "left_anti").select("conv_id", F.col("i").cast("long").alias("n_turns"), "n_copies")


def collapse_and_render(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies, rendered: the maximal conversations as marked-up text."""
    turns = turns_of(conversations)
    best = maximal_conversations(turns)
    line = F.concat(F.lit(START), "role", F.lit("\n"), "text", F.lit(f"{STOP}\n"))
    lines = turns.join(best.select("conv_id"), "conv_id", "left_semi").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("i", line.alias("line")))).alias("lines"))
    return best.join(lines, "conv_id").select("conv_id", "n_turns", "n_copies", F.array_join(F.col("lines.line"), "").alias("rendered"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_and_render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP4_SQL = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i,
                  '{START}' || coalesce(role, '') || chr(10) || coalesce(text, '') || '{STOP}' || chr(10) AS line
           FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT conv_id, i, max(i) OVER (PARTITION BY conv_id) AS n, string_agg(line, '') OVER (PARTITION BY conv_id ORDER BY i) AS prefix FROM t),
f AS (SELECT n, prefix, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE i = n GROUP BY n, prefix)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, CAST(n_copies AS BIGINT) AS n_copies, prefix AS rendered FROM f
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.i < p.n AND p.i = f.n AND p.prefix = f.prefix)
"""
