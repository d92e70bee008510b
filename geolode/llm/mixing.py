"""Mixing sources to target weights by capped water-filling.

Every source asks for words in proportion to its weight. A source that would
need more than ``max_epochs`` passes over its documents is clamped there and
its excess goes to the others by weight, until none is above its clamp. Each
document is then taken ``whole`` times, and once more where its seeded hash
lies at or below its source's threshold. The threshold is the hash at which the
running sum of sizes, in hash order, comes nearest to the words still missing,
so a source misses its target by half a document at most.

The threshold is found by radix descent: sums of sizes by ten bits of the hash
at a time, each level over the one bucket that the last level chose. So no task
ever sees a source's documents together, however large the source.

Everything is DataFrame functions. Nulls: a null text has size 0, a null source
is a source of its own and comes last, a null key is hashed like a value. Equal
rows share a hash and are taken alike. Empty tables give empty results. Other
columns are kept where whole rows are returned.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geolode.llm.common import n_words, table, written

SEED = 17
MAX_EPOCHS = 3
#: Rows of a table of sources that may be broadcast; more are joined by a shuffle.
SMALL = 200_000
_BITS, _LEVELS = 10, 4


def _source_key(source: str) -> Column:
    return F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source).cast("string")))


def _hash40(seed: int, key: str, text: str) -> Column:
    """40 bits that depend on the seed, the key and the text only; other engines can compute them too."""
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit(""))))
    return F.conv(F.substring(F.md5(said), 1, 10), 16, 10).cast("long")


def _near(small: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(small) if rows <= SMALL else small


def ranked(sources: DataFrame, by: Column, name: str) -> DataFrame:
    """Adds each row's place (from 0) in the order of ``by``: ranges are sorted apart, then offset by the rows before them."""
    cut = written(sources.repartitionByRange(by).withColumn("_range", F.spark_partition_id()))
    before = cut.groupBy("_range").count().withColumn("_before", F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(by)) - 1
    return cut.withColumn("_at", place).join(F.broadcast(before.drop("count")), "_range").withColumn(name, (F.col("_at") + F.coalesce("_before", F.lit(0))).cast("long")).drop("_range", "_at", "_before")


def fill(sources: DataFrame, max_epochs: int) -> DataFrame:
    """Adds ``target`` to rows with ``source_size`` and integer ``weight``: the water level, found from sums alone."""
    capped = F.col("source_size") * max_epochs
    total, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    clamped, taken, left, level = 0, 0, weights or 0, 0.0
    while left:
        level = ((total or 0) - taken) / left
        over = capped <= F.lit(level) * F.col("weight")
        n, taken, left = sources.agg(F.count(F.when(over, 1)), F.coalesce(F.sum(F.when(over, capped)), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))).first()
        if n == clamped:
            break
        clamped = n
    return sources.withColumn("target", F.round(F.least(capped.cast("double"), F.lit(level) * F.col("weight")), 6))


def thresholds(sized: DataFrame, plan: DataFrame, n_sources: int) -> DataFrame:
    """Adds ``whole`` and ``last`` to the plan: passes for every document, and the last hash that is taken once more.

    ``sized`` has ``skey``, ``size`` and ``u``.
    """
    size = F.col("source_size")
    whole = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("whole", whole).withColumn("extra", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * size))
    state = plan.select("skey", "extra", F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("prefix"))
    for k in range(1, _LEVELS + 1):
        shift = _BITS * (_LEVELS - k)
        here = sized.join(_near(state, n_sources), "skey").where(F.shiftright("u", shift + _BITS) == F.col("prefix"))
        sums = here.groupBy("skey", "extra", "before", F.shiftright("u", shift).alias("at")).agg(F.sum("size").alias("words"))
        upto = F.col("before") + F.sum("words").over(Window.partitionBy("skey").orderBy("at"))
        sums = sums.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("words"))
        edge = sums.where((F.col("before") <= F.col("extra")) & (F.col("upto") > F.col("extra")))
        state = written(edge.select("skey", "extra", "before", "upto", F.col("at").alias("prefix")))
    nearest = F.col("prefix") - F.when(F.col("before") + F.col("upto") <= 2 * F.col("extra"), 0).otherwise(1)
    found = state.select("skey", nearest.alias("_last"))
    return plan.join(_near(found, n_sources), "skey", "left").withColumn("last", F.coalesce("_last", F.lit(1 << _BITS * _LEVELS))).drop("_last", "extra")


def mix_plan(docs: DataFrame, weight: Callable[[DataFrame], DataFrame], max_epochs: int = MAX_EPOCHS, seed: int = SEED, key: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame, int]:
    """(sizes of all documents, plan by source, number of sources).

    ``weight`` adds an integer column ``weight`` to rows with ``source``,
    ``skey`` and ``source_size``. Targets share the sum of all sizes.
    """
    sized = written(docs.select(F.col(key), _source_key(source).alias("skey"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), _hash40(seed, key, text).alias("u")))
    sources = written(weight(sized.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))))
    n = sources.count()
    plan = written(thresholds(sized, fill(sources, max_epochs), n))
    return sized, plan, n


def mixed(docs: DataFrame, plan: DataFrame, n_sources: int, seed: int = SEED, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: every document as often as the plan takes it, with its columns."""
    columns = docs.columns
    plan = plan.select("skey", F.col("whole").alias("__whole"), F.col("last").alias("__last"))
    took = docs.withColumn("skey", _source_key(source)).join(_near(plan, n_sources), "skey")
    times = F.col("__whole") + (_hash40(seed, key, text) <= F.col("__last")).cast("long")
    return took.withColumn("__times", times).where("__times > 0").withColumn("__time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times")))).select(*[F.col(f"`{c}`") for c in columns])


def cycled_weights(sources: DataFrame) -> DataFrame:
    """Weights 1, 2, 3, 1, ... by code point order of the sources, null last."""
    return ranked(sources, F.col("source").asc_nulls_last(), "_place").withColumn("weight", F.col("_place") % 3 + 1).drop("_place")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized, plan, n = mix_plan(table(spark, sf_dir, "documents"), cycled_weights)
    took = sized.drop("source").join(_near(plan.select("skey", "source_size", "target", "whole", "last"), n), "skey")
    return took.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("whole") + (F.col("u") <= F.col("last")).cast("long"))).alias("taken"))


SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 10))::BIGINT AS u
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM src),
cum AS (SELECT
    (sum(source_size) OVER ())::BIGINT - coalesce(sum(cap) OVER w, 0)::BIGINT AS words_left,
    (sum(weight) OVER ())::BIGINT - coalesce(sum(weight) OVER w, 0)::BIGINT AS weight_left
  FROM weighed WINDOW w AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
water AS (SELECT coalesce(max(words_left::DOUBLE / weight_left), 0) AS level FROM cum),
plan AS (SELECT source, source_size, round(least(cap::DOUBLE, level * weight), 6) AS target FROM weighed, water),
planned AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM plan),
summed AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.whole, greatest(0, p.target - p.whole * p.source_size) AS extra,
    (sum(s.size) OVER (PARTITION BY s.source ORDER BY s.u))::BIGINT AS upto, (sum(s.size) OVER (PARTITION BY s.source, s.u))::BIGINT AS own
  FROM sized s JOIN planned p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, size * (whole + CASE WHEN 2 * upto - own <= 2 * extra THEN 1 ELSE 0 END) AS taken FROM summed
"""
