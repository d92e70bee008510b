"""Quality classifier: regularised quadratic discriminant over statistics of a text.

Each text gives a few transformed statistics. Per class their mean and
covariance are sums over all training rows; a covariance is shrunk towards the
pooled one and that towards its diagonal. The score is the logistic of the
difference of the two log densities, Mahalanobis terms through the inverse
Cholesky factors, which are worked out once on the driver (a few dozen numbers)
and enter the plan as constants.

Nulls count as empty texts and are scored like any other. A label of a text
that occurs more than once trains once for each row. Labels other than 0 and 1
are ignored; with no training rows of a class every score is the other class's
(0.5 with none at all). Equal rows give equal rows, empty tables an empty
result. Labels, language, source and key are no inputs of a score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geolode.llm.common import table, written

#: Weight of the pooled covariance in a class's, and of the diagonal in the pooled.
POOL, DIAGONAL = 0.3, 0.2
#: Added to each variance, so that a statistic that never varies does no harm.
RIDGE = 0.02

STATISTICS = ["symbols", "upper", "bangs", "digits", "pairs", "windows", "length", "points"]
_SPACE = b" \t\n\x0b\x0c\r"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def statistics(raw: bytes) -> list[float]:
    """Transformed statistics of a whole text: shares as logarithms, so that rates near nothing differ little."""
    words = raw.split()
    n = len(words)
    left = lambda of: len(raw) - len(raw.translate(None, of))
    letters = left(_UPPER + _UPPER.lower())
    solid = max(1, len(raw) - left(_SPACE))
    per_word = lambda x: math.log1p(10 * x / (n + 5))
    same = sum(map(bytes.__eq__, words, words[1:])) if n > 1 else 0
    windows = n - 2 - len(set(zip(words, words[1:], words[2:], strict=False))) if n > 2 else 0
    return [
        per_word(left(b"#*$%&|<>~^_=+{}[]\\")),
        math.log1p(20 * left(_UPPER) / (letters + 50)),
        per_word(left(b"!?")),
        math.log1p(20 * left(b"0123456789") / (solid + 50)),
        per_word(same),
        per_word(windows),
        math.log((solid + 25) / (n + 5)),
        per_word(left(b".,;:")),
    ]


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows as a struct ``row``, whatever their columns are called, and their statistics ``x``."""
    whole = docs.select(F.struct("*").alias("row"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([whole.schema["row"], T.StructField("x", T.ArrayType(T.DoubleType()))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([statistics(r or b"") for r in raw], pa.list_(pa.float64()))], ["row", "x"])

    return whole.mapInArrow(rows, schema)


def fit(labelled: DataFrame) -> dict:
    """Model from rows (``label`` 0 or 1, ``x``): counts, sums and sums of products, added up on the executors."""
    d = len(STATISTICS)
    at = [F.col("x")[i] for i in range(d)]
    sums = [F.sum(at[i]) for i in range(d)]
    products = [F.sum(at[i] * at[j]) for i in range(d) for j in range(i + 1)]
    found = labelled.where("label in (0, 1)").groupBy("label").agg(F.count("*"), *sums, *products).collect()
    by = {int(r[0]): r for r in found}
    if len(by) < 2:
        return {"constant": 0.5 if not by else float(next(iter(by)))}
    means, scatter, counts = {}, {}, {}
    for k, r in by.items():
        n, mean = r[1], np.array(r[2 : 2 + d]) / r[1]
        cov, values = np.zeros((d, d)), iter(r[2 + d :])
        for i in range(d):
            for j in range(i + 1):
                cov[i, j] = cov[j, i] = next(values) / n - mean[i] * mean[j]
        means[k], scatter[k], counts[k] = mean, cov, n
    total = sum(counts.values())
    pooled = sum(counts[k] * scatter[k] for k in by) / total
    pooled = (1 - DIAGONAL) * pooled + DIAGONAL * np.diag(np.diag(pooled))
    classes = {}
    for k in by:
        cov = (1 - POOL) * scatter[k] + POOL * pooled + RIDGE * np.eye(d)
        low = np.linalg.cholesky(cov)
        # Cached: the inverse factor, and the part of the log density that no text changes.
        classes[k] = (means[k], np.linalg.inv(low), math.log(counts[k] / total) - float(np.log(np.diag(low)).sum()))
    return {"classes": classes}


def score(model: dict, x: Column) -> Column:
    """Probability of label 1 as an expression over the statistics."""
    if "constant" in model:
        return F.lit(model["constant"])

    def density(k: int) -> Column:
        mean, inverse, constant = model["classes"][k]
        out = F.lit(constant)
        for i in range(len(mean)):
            z = F.lit(0.0)
            for j in range(i + 1):
                z = z + F.lit(float(inverse[i, j])) * (x[j] - F.lit(float(mean[j])))
            out = out - F.lit(0.5) * z * z
        return out

    gap = density(1) - density(0)
    return 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), gap))))


def held_out(key: Column) -> Column:
    """Rows that no label is learned from: a third, by CRC-32 of the key as text."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def fit_on(x: DataFrame, labels: DataFrame) -> dict:
    """Model from statistics (``key``, ``x``) and ``labels`` (doc_id, quality), held-out rows left aside."""
    marks = labels.select(F.col("doc_id").alias("key"), F.col("quality").alias("label")).where(~held_out(F.col("key")))
    return fit(x.join(marks, "key").select("label", "x"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    x = written(measured(docs).select(F.col("row.doc_id").alias("key"), "x"))
    model = fit_on(x, table(spark, sf_dir, "labels"))
    scored = x.select(F.col("key").alias("doc_id"), held_out(F.col("key")).alias("held_out"), score(model, F.col("x")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that the classifier does not reject, with their columns."""
    rows = measured(docs)
    model = fit_on(written(rows.select(F.col("row.doc_id").alias("key"), "x")), labels)
    return rows.where(score(model, F.col("x")) >= 0.5).select("row.*")
