"""Quality rules as a short-circuit cascade.

Two base rules stand first by contract; a text that passes them meets the
others, each a comparison of whole numbers. A text is kept if no rule rejects
it, so their order never changes a verdict, only its price. The order comes
from a sample: every rule is timed on every sampled text, then the rule with
most rejections per second among the texts still alive goes first, and so on.

Nulls count as empty texts: no words, hence rejected by the base. Equal rows
give equal rows. Texts of any length are read whole. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from geolode.llm.common import table

#: Texts that the order of the rules is estimated on, about.
SAMPLE = 2_000
SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()
_DIGITS = b"0123456789"


class Facts:
    """Statistics of one text, each worked out when first asked for."""

    def __init__(self, raw: bytes, n_chars: int):
        self.raw, self.n_chars = raw, n_chars

    def count(self, of: bytes) -> int:
        return len(self.raw) - len(self.raw.translate(None, of))

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()  # bytes split at ASCII white space only

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return self.n_chars - self.count(_SPACE)

    @cached_property
    def n_symbols(self) -> int:
        return self.count(SYMBOLS)

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip(_SPACE)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        w = self.words
        windows = list(zip(w, w[1:], w[2:], strict=False))
        seen = Counter(windows)
        if len(seen) == len(windows):
            return 0
        covered = bytearray(len(w))
        for i, x in enumerate(windows):
            if seen[x] > 1:
                covered[i : i + 3] = b"\1\1\1"
        return sum(covered)

    @cached_property
    def top_word(self) -> int:
        return max(Counter(self.words).values(), default=0)

    @property
    def base_failed(self) -> bool:
        return self.n_words < 50 or 100 * self.n_repeat_words > 50 * self.n_words


#: name: whether the rule rejects a text.
RULES: dict[str, Callable[[Facts], bool]] = {
    "symbols": lambda f: 10 * f.n_symbols > 3 * f.n_words,
    "word_length": lambda f: f.word_chars < 2 * f.n_words or f.word_chars > 15 * f.n_words,
    "upper": lambda f: f.count(_UPPER) > f.count(_LOWER),
    "bangs": lambda f: 10 * f.count(b"!") > 3 * f.n_words,
    "digits": lambda f: 10 * f.count(_DIGITS) > 3 * f.word_chars,
    "dup_lines": lambda f: 2 * f.n_dup_lines > len(f.lines),
    "top_word": lambda f: 10 * f.top_word > 3 * f.n_words,
}


def _facts(column: pa.Array) -> Iterator[Facts]:
    sizes = pc.utf8_length(column).to_pylist()
    for raw, n in zip(column.cast(pa.binary()).to_pylist(), sizes, strict=True):
        yield Facts(raw or b"", n or 0)


def estimate_order(docs: DataFrame, text: str = "text", sample: int = SAMPLE, seed: int = 5, rules: dict[str, Callable[[Facts], bool]] = RULES) -> list[str]:
    """Names of the rules, most rejections per second first, each given those before it."""
    n = docs.count()
    names = list(rules)

    def timed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rejects, seconds = [], []
            for f in _facts(batch.column(0)):
                if f.base_failed:
                    continue
                bits, spent = [], []
                for name in names:
                    alone = Facts(f.raw, f.n_chars)
                    alone.words, alone.n_words  # noqa: B018  the base has split the words already
                    began = time.perf_counter()
                    bits.append(bool(rules[name](alone)))
                    spent.append(time.perf_counter() - began)
                rejects.append(bits)
                seconds.append(spent)
            yield pa.RecordBatch.from_arrays([pa.array(rejects, pa.list_(pa.bool_())), pa.array(seconds, pa.list_(pa.float64()))], ["rejects", "seconds"])

    some = docs.select(text).sample(fraction=min(1.0, sample / n), seed=seed) if n else docs.select(text)
    alive = some.mapInArrow(timed, "rejects array<boolean>, seconds array<double>").collect()
    order, left = [], list(range(len(names)))
    while left:
        gain = lambda k: (sum(r.rejects[k] for r in alive) / (sum(r.seconds[k] for r in alive) + 1e-9), -k)  # noqa: B023, E731
        best = max(left, key=gain)
        order.append(names[best])
        left.remove(best)
        alive = [r for r in alive if not r.rejects[best]]
    return order


def judge(docs: DataFrame, order: list[str], key: str = "doc_id", text: str = "text", rules: dict[str, Callable[[Facts], bool]] = RULES) -> DataFrame:
    """Per row the base statistics, ``base_failed``, ``kept`` and ``rejected_by``, the first rule of the cascade that rejects (null: none)."""
    numbers = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *(T.StructField(x, T.LongType()) for x in numbers), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("rejected_by", T.StringType())])
    cascade = [(name, rules[name]) for name in order]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for f in _facts(batch.column(1)):
                failed = f.base_failed
                by = "base" if failed else next((name for name, rejects in cascade if rejects(f)), None)
                out.append((*(getattr(f, x) for x in numbers), failed, by is None, by))
            columns = list(zip(*out, strict=True)) or [()] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], schema.names)

    return docs.select(key, text).mapInArrow(rows, schema)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, estimate_order(docs)).drop("rejected_by")


SQL = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
grams AS (SELECT rid, i, words[i] || chr(10) || words[i+1] || chr(10) || words[i+2] AS g FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM dup, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
top AS (SELECT rid, max(n) AS n FROM (SELECT rid, x, count(*) AS n FROM (SELECT rid, unnest(words) AS x FROM w) GROUP BY rid, x) GROUP BY rid),
f AS (
  SELECT w.rid, doc_id, len(words)::BIGINT AS n_words, (length(text) - length(regexp_replace(text, '[^\x20\x09-\x0D]', '', 'g')))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(top.n, 0) AS top_word,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS upper, length(regexp_replace(text, '[^a-z]', '', 'g')) AS lower,
    length(regexp_replace(text, '[^!]', '', 'g')) AS bangs, length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits
  FROM w LEFT JOIN rep USING (rid) LEFT JOIN top USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR upper > lower OR 10 * bangs > 3 * n_words
    OR 10 * digits > 3 * word_chars OR 2 * n_dup_lines > n_lines OR 10 * top_word > 3 * n_words) AS kept
FROM b
"""
