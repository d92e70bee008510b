"""Chat formatting with collapse of cumulative snapshots.

Logs often hold one conversation many times, each a prefix of the next. Every
turn gets the hash of all turns up to it, rolled along the conversation; a
conversation whose last hash is a prefix hash of a longer one is a snapshot and
goes (anti-join), and of equal ones the least id stays. What is left is
rendered, ``PART`` turns to a row, so that no row grows with a conversation.

The rolling hash is a sum of hashes of (place, turn), 128 bits in four halves
of 32, so that prefix sums can be taken in two steps: within chunks, and over
the chunks' totals. Chunks are ranges of the table in the order of conversation
and turn, so a long conversation (or all turns without id or number) lies in
many, and no task sees it whole. Prefix
hashes are reduced to the longest conversation that has them before the join,
so a first turn that a third of all conversations share is one row there.

Everything is DataFrame functions. Turns go by turn number, then role, then
text, nulls last in each; equal rows are turns of their own. Turns without
conversation id form one conversation of their own, with a null id. A null role
or text is rendered as an empty string but differs from one when prefixes are
compared. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geolode.llm.common import table, written

PART = 256
_KEY = ["ckey", "chunk"]


def _placed(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Turns with ``ckey`` (never null), ``conv_id``, their place ``pos`` from 1, ``role``, ``text``, and the ``chunk`` they lie in."""
    ckey = F.when(F.col(conv).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(conv).cast("string")))
    # Equal rows are interchangeable; their number lets a range end between them.
    t = turns.select(ckey.alias("ckey"), F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("tie"))
    order = [F.col(c).asc_nulls_last() for c in ("turn", "role", "text", "tie")]
    t = written(t.repartitionByRange("ckey", *order).withColumn("chunk", F.spark_partition_id()))
    before = t.groupBy(*_KEY).count().withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy("ckey").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = F.row_number().over(Window.partitionBy(*_KEY).orderBy(*order))
    return t.withColumn("at", at).join(before.drop("count"), _KEY).withColumn("pos", F.col("before") + F.col("at")).select("ckey", "chunk", "conv_id", "pos", "role", "text")


def _rolled(placed: DataFrame) -> DataFrame:
    """``ckey``, ``conv_id``, ``pos`` and the rolling hash ``s0``..``s3`` of the turns up to each."""
    said = [F.col("pos"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    h = placed.select("ckey", "chunk", "conv_id", "pos", F.xxhash64(*said).alias("a"), F.xxhash64(F.lit(7), *said).alias("b"))
    low, high = F.lit(0xFFFFFFFF).cast("long"), 32
    halves = [F.col("a").bitwiseAND(low), F.shiftrightunsigned("a", high), F.col("b").bitwiseAND(low), F.shiftrightunsigned("b", high)]
    inside = Window.partitionBy(*_KEY).orderBy("pos")
    h = h.select("ckey", "chunk", "conv_id", "pos", *(F.sum(x).over(inside).alias(f"i{k}") for k, x in enumerate(halves)))
    h = written(h)
    earlier = Window.partitionBy("ckey").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = h.groupBy(*_KEY).agg(*(F.max(f"i{k}").alias(f"t{k}") for k in range(4)), F.count("*").alias("n"))
    totals = totals.select(*_KEY, *(F.coalesce(F.sum(f"t{k}").over(earlier), F.lit(0)).alias(f"t{k}") for k in range(4)), F.sum("n").over(Window.partitionBy("ckey")).alias("n_turns"))
    return h.join(totals, _KEY).select("ckey", "conv_id", "pos", "n_turns", *((F.col(f"t{k}") + F.col(f"i{k}")).alias(f"s{k}") for k in range(4)))


def maximal(rolled: DataFrame) -> DataFrame:
    """``ckey`` and ``n_turns`` of the conversations that are no snapshot of another."""
    same = ["pos", "s0", "s1", "s2", "s3"]
    finals = rolled.where("pos = n_turns").groupBy(*same).agg(F.min_by("ckey", F.struct(F.col("conv_id").isNull(), "conv_id")).alias("ckey"))
    longer = rolled.groupBy(*same).agg(F.max("n_turns").alias("longest")).where("longest > pos")
    return finals.join(longer, same, "left_anti").select("ckey", F.col("pos").alias("n_turns"))


def formatted(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id``, ``n_turns``, ``part`` (from 0) and the rendered ``text`` of every conversation kept."""
    placed = written(_placed(turns, conv, turn, role, text))
    kept = maximal(_rolled(placed))
    said = F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n"))
    rows = placed.join(kept, "ckey").select("ckey", "conv_id", "n_turns", F.floor((F.col("pos") - 1) / PART).alias("part"), F.struct("pos", said.alias("said")).alias("turn"))
    parts = rows.groupBy("ckey", "conv_id", "n_turns", "part").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return parts.select("conv_id", "n_turns", "part", F.array_join(F.transform("turns", lambda x: x["said"]), "").alias("text"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted(table(spark, sf_dir, "conversations"))


SQL = f"""
WITH placed AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS LAST, text NULLS LAST) AS pos, count(*) OVER (PARTITION BY conv_id) AS n_turns
  FROM conversations),
rolled AS (
  SELECT *, md5(string_agg(md5(coalesce('r' || role, 'n') || chr(1) || coalesce('t' || text, 'n')), ',') OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS h
  FROM placed),
longest AS (SELECT pos, h, max(n_turns) AS n FROM rolled GROUP BY pos, h),
kept AS (
  SELECT conv_id FROM (SELECT r.conv_id, row_number() OVER (PARTITION BY r.pos, r.h ORDER BY r.conv_id NULLS LAST) AS k
    FROM rolled r JOIN longest l USING (pos, h) WHERE r.pos = r.n_turns AND l.n = r.pos) WHERE k = 1)
SELECT p.conv_id, p.n_turns, ((p.pos - 1) // {PART})::BIGINT AS part,
  string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS text
FROM placed p JOIN kept k ON p.conv_id IS NOT DISTINCT FROM k.conv_id GROUP BY 1, 2, 3
"""
