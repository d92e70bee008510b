"""Secret scans with linking of credentials that come in parts.

Three kinds of strings are secrets by themselves: an assignment to a telling
name, an access identifier and a long hexadecimal run. Others are weak: forty
characters of a secret key's alphabet, or the address of a service, mean
nothing alone. A weak candidate is reported only when a complementary part
stands within ``reach`` characters of it: a key needs an access identifier, an
endpoint needs an access identifier, a key that has one or an assignment.
A key and an endpoint alone do not make each other secrets.

Places come from the gaps between matches (``split``) and the matches
themselves, so nothing leaves the JVM. The linking is an interval join: each
weak part lies in all buckets that it touches, each anchor in those within
reach of it, and pairs in one bucket of one text are held against the distance.
Parts of a kind do not overlap and are 20 characters long at least, so a bucket
holds a bounded number of them, however long they are, and the join's output
grows with the text only.
Only texts that hold both an anchor and a weak candidate reach the join.

Nulls count as empty texts: no spans, the digest of the empty string. Rows with
equal key and text have equal spans. Whole texts are scanned. Places count code
points, ends are exclusive. Other columns are ignored or, in ``redacted``, kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geolode.llm.common import table, written

#: The patterns of the three strong kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a run that starts with the first AKIA in it; shorter ones fail anyway
HEX = r"[0-9a-f]{24,}"  # all of a run: the same matches as runs of any length with the short ones dropped

#: Weak kinds.
KEY = r"(?<![A-Za-z0-9/+=])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])"
ENDPOINT = r"https?://[A-Za-z0-9._~:/?#@!$&*+,;=%-]{13,}"

KINDS = ["assign", "access", "hex", "key", "endpoint"]
REACH = 400
_PART = "array<struct<start:long,kind:int,end:long>>"


def _running(items: Column, value, combine) -> Column:
    """For each element the numbers (from 0) of those before it, combined: in parts of 256, then over the parts, so that long arrays cost little more than their length."""
    zero = F.lit(0).cast("long")

    def before(xs, of):
        first = F.struct(zero.alias("at"), F.array().cast("array<long>").alias("done"))
        return F.aggregate(xs, first, lambda s, x: F.struct(combine(s["at"], of(x)).alias("at"), F.array_append(s["done"], s["at"]).alias("done")))

    def by_parts(xs):
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / 256).cast("int")), lambda k: before(F.slice(xs, k * 256 + 1, F.lit(256)), value))
        return F.transform(F.array(parts), lambda ps: F.flatten(F.zip_with(ps, before(ps, lambda p: p["at"])["done"], lambda p, o: F.transform(p["done"], lambda y: combine(y, o)))))[0]

    none = F.array().cast("array<long>")
    return F.transform(F.array(items), lambda xs: F.when(F.size(xs) > 0, by_parts(xs)).otherwise(none))[0]


def _matches(text: Column, pattern: str, kind: int, needs: Column, keep=None) -> Column:
    """Spans of a pattern: starts are sums of the lengths of the gaps and matches before. ``needs`` is a cheap test that every text with a match passes."""
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("long"))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.transform(F.arrays_zip(gaps.alias("gap"), found.alias("hit")), lambda x: F.struct(x["gap"].alias("gap"), F.coalesce(F.length(x["hit"]), F.lit(0)).cast("long").alias("size"), (keep(x["hit"]) if keep else F.lit(True)).alias("ok")))
    at = _running(steps, lambda x: x["gap"] + x["size"], lambda a, b: a + b)
    spans = F.transform(F.arrays_zip(steps.alias("x"), at.alias("at")), lambda z: F.struct((z["at"] + z["x"]["gap"]).alias("start"), F.lit(kind).alias("kind"), (z["at"] + z["x"]["gap"] + z["x"]["size"]).alias("end"), ((z["x"]["size"] > 0) & z["x"]["ok"]).alias("ok")))
    spans = F.transform(F.filter(spans, lambda s: s["ok"]), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return F.when(needs, spans).otherwise(F.array().cast(_PART))


def _digest(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _parts(docs: DataFrame, key: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    long_value = lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 2)) >= 6
    named = t.rlike(r"(?i)(?:passw(?:or)?d|secret|token|api_?key)[\"']?\x20*[:=]")
    # A key counts only with an access identifier, an endpoint with that or an assignment; other texts are not searched for them.
    row = docs.select(F.col(key).alias("key"), F.xxhash64(t, F.length(t)).alias("th"), t.alias("t"), named.alias("named"), t.contains("AKIA").alias("aki"), t.rlike(HEX).alias("hexed"))
    return row.select(
        "key",
        "th",
        _matches(F.col("t"), ASSIGN, 0, F.col("named"), long_value).alias("assign"),
        _matches(F.col("t"), ACCESS, 1, F.col("aki")).alias("access"),
        _matches(F.col("t"), HEX, 2, F.col("hexed")).alias("hex"),
        _matches(F.col("t"), KEY, 3, F.col("aki")).alias("weak_key"),
        _matches(F.col("t"), ENDPOINT, 4, (F.col("aki") | F.col("named")) & F.col("t").contains("://")).alias("weak_end"),
    )


def _near(weak: DataFrame, anchors: DataFrame, reach: int) -> DataFrame:
    """Weak parts that have an anchor of the same text within reach. The distance is the gap between the two spans."""
    a = anchors.select("key", "th", F.col("s.start").alias("a0"), F.col("s.end").alias("a1"))
    # An anchor covers all buckets within reach of it and a weak part all from its start to its end, so that one equality finds every pair.
    a = a.withColumn("b", F.explode(F.sequence(F.floor((F.col("a0") - reach) / reach), F.floor((F.col("a1") + reach) / reach))))
    w = weak.withColumn("b", F.explode(F.sequence(F.floor(F.col("s.start") / reach), F.floor(F.col("s.end") / reach))))
    same = w["key"].eqNullSafe(a["key"]) & (w["th"] == a["th"]) & (w["b"] == a["b"])
    gap = F.greatest(w["s.start"] - a["a1"], a["a0"] - w["s.end"], F.lit(0).cast("long"))
    return w.join(a, same & (gap <= reach), "left_semi").drop("b").distinct()


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """One row per row of ``docs``: the key, ``th`` (a hash of the text), ``base`` and ``spans`` (sorted arrays of start, kind, end)."""
    parts = written(_parts(docs, key, text))
    linkable = ((F.size("access") > 0) & (F.size("weak_key") > 0)) | ((F.size("access") + F.size("assign") > 0) & (F.size("weak_end") > 0))
    both = parts.where(linkable).dropDuplicates(["key", "th"])
    access = both.select("key", "th", F.explode("access").alias("s"))
    named = both.select("key", "th", F.explode("assign").alias("s"))
    # What a strong span already covers is no key of its own.
    strong = F.concat("assign", "access", "hex")
    free = F.filter("weak_key", lambda w: ~F.exists(strong, lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"])))
    keys = written(_near(both.select("key", "th", F.explode(free).alias("s")), access, reach))
    ends = _near(both.select("key", "th", F.explode("weak_end").alias("s")), access.unionByName(named).unionByName(keys), reach)
    linked = keys.unionByName(ends).groupBy("key", "th").agg(F.collect_list("s").alias("more"))
    base = F.concat("assign", "access", "hex")
    linked = linked.select(F.col("key").alias("lk"), F.col("th").alias("lh"), "more")
    out = parts.join(linked, parts["key"].eqNullSafe(linked["lk"]) & (parts["th"] == linked["lh"]), "left")
    none = F.array().cast(_PART)
    return out.select(F.col("key").alias(key), "th", "assign", "access", "hex", F.array_sort(base).alias("base"), F.array_sort(F.concat(base, F.coalesce("more", none))).alias("spans"))


_BLOCK = 4096


def _cut(blocks: Column, start: Column, end: Column) -> Column:
    """Characters from start to end of a text in blocks."""
    i, j = F.floor(start / _BLOCK).cast("int"), F.floor(end / _BLOCK).cast("int")
    first = lambda n: F.substring(F.coalesce(F.get(blocks, i), F.lit("")), (start % _BLOCK + 1).cast("int"), n)
    many = F.concat(first(F.lit(_BLOCK)), F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(F.coalesce(F.get(blocks, j), F.lit("")), F.lit(1), (end % _BLOCK).cast("int")))
    return F.when(end <= start, "").when(i == j, first((end - start).cast("int"))).otherwise(many)


def redacted(docs: DataFrame, key: str = "doc_id", text: str = "text", reach: int = REACH, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every reported span (overlapping ones joined) replaced by a mark."""
    columns = docs.columns
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    spans = scan(docs, key, text, reach).where(F.size("spans") > 0).select(F.col(key).alias("__k"), F.col("th").alias("__h"), F.col("spans").alias("__s")).dropDuplicates(["__k", "__h"])
    rows = docs.withColumn("__th", F.xxhash64(t, F.length(t)))
    rows = rows.join(spans, rows[key].eqNullSafe(spans["__k"]) & (rows["__th"] == spans["__h"]), "left")
    # The text in blocks, so that a piece is cut out of its blocks and not by counting from the text's start.
    blocks = F.regexp_extract_all(t, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))
    whole = F.struct(blocks.alias("b"), F.col("__s").alias("s"), _running(F.col("__s"), lambda s: s["end"], F.greatest).alias("done"), F.length(t).cast("long").alias("n"))

    def cleaned(w):
        parts = F.zip_with(w["s"], w["done"], lambda s, done: F.when(s["start"] < done, F.lit("")).otherwise(F.concat(_cut(w["b"], done, s["start"]), F.lit(mark))))
        return F.concat(F.array_join(parts, ""), _cut(w["b"], F.array_max(F.transform(w["s"], lambda s: s["end"])), w["n"]))

    clean = F.transform(F.array(whole), cleaned)[0]
    rows = rows.withColumn(text, F.when(F.col("__s").isNull(), F.col(f"`{text}`")).otherwise(clean))
    return rows.select(*[F.col(f"`{c}`") for c in columns])


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    size = lambda c: F.size(c).cast("long")
    return found.select("doc_id", size("assign").alias("n_assign"), size("access").alias("n_access"), size("hex").alias("n_hex"), F.sha2(_digest(F.col("base")), 256).alias("base_sha256"), _digest(F.col("spans")).alias("spans"))
