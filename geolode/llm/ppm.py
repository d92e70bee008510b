"""Scoring of texts by prediction by partial matching, pretrained on the corpus.

The model is a trie of byte contexts up to ``ORDER`` long. A byte that followed
a context ``c`` in training has probability count / (n + d) there, where n is
how often c was followed and d by how many different bytes; d / (n + d) is left
for escape to the context one byte shorter, in which the bytes already offered
are excluded. Contexts are counted at all lengths, so what a context offers its
suffix offers too: exclusion on the way down depends on two neighbouring
contexts only, and n, d and X (the suffix's count of the bytes excluded) of
each context give every probability. Below the empty context the bytes never
seen share evenly. The byte 255, which no UTF-8 text holds, ends each text.

Nothing of the size of the corpus is broadcast or collected. Texts are packed in
blocks of bounded size. A block sends the distinct strings it holds, with their
training counts, dealt by hash of the last two bytes of the context, so that a
context, its suffixes and all their continuations meet; the counts are added up
(salted first, then by range), the statistics worked out, and each block gets
back the numbers of its own strings only. Words for the base score go the same
way by their hash. Strings of one and two bytes are few (a table of 65,792
counts at most), which the driver adds up.

Nulls count as empty texts: the end alone. A null id is not held out. Equal
rows give equal rows, empty tables an empty result; with no training text at
all, every byte has probability 1/256. Other columns are ignored. Texts are
scored whole.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolode.llm.common import table, written

#: Longest context, bytes of text in a block, and blocks whose counts one task adds up.
ORDER, BLOCK_BYTES, TOGETHER = 5, 8 << 20, 256
END = 255
#: Positions or strings worked on at once, and positions counted or sorted at once.
STEP, SPAN = 1 << 18, 1 << 20
_DOC, _LOW, _GRAM, _WORD = 0, 1, 2, 3
_PACKED = "block long, kind int, range int, seq int, a binary, b binary"
_LN10 = float(np.log(10.0))


def _zip(x: np.ndarray) -> bytes:
    """Numbers as bytes; planes of equal significance together, so that small numbers shrink."""
    if not len(x):
        return b""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T
    return zlib.compress(planes.tobytes(), 1)


def _unzip(raw: bytes, dtype) -> np.ndarray:
    if not raw:
        return np.zeros(0, dtype)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(size, -1).T).view(dtype).ravel()


def _zip_sorted(keys: np.ndarray) -> bytes:
    return _zip(np.diff(keys, prepend=keys[:1] * 0))


def _unzip_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(_unzip(raw, np.uint64), dtype=np.uint64)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def _numbered(key: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of ``key`` below ``none`` in order, and each element's place among them (their number for ``none``).

    ``key`` may be overwritten.

    Present values are bits, 64 a word with the rank of the word's first, so the
    room taken is by values present and a bit for each possible one; sparser
    values are numbered by sorting alone.
    """
    found = _distinct(np.concatenate([_distinct(key[lo : lo + SPAN]) for lo in range(0, len(key), SPAN)] or [key]))
    if len(found) and found[-1] == none:
        found = found[:-1]
    at = key if key.dtype == np.int32 else np.empty(len(key), np.int32)  # a slice is read before its places are put there
    if none > 32 * len(key):
        for lo in range(0, len(key), STEP):
            at[lo : lo + STEP] = np.searchsorted(found, key[lo : lo + STEP])
        return found, at
    word = found >> 6
    begin = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(found) else np.zeros(0, np.int64)
    bits = np.zeros((none >> 6) + 1, np.uint64)
    if len(found):
        bits[word[begin]] = np.bitwise_or.reduceat(np.uint64(1) << (found & 63).astype(np.uint64), begin)
    del word, begin
    rank = np.zeros(len(bits), np.int32)
    np.cumsum(np.bitwise_count(bits[:-1]), out=rank[1:])
    for lo in range(0, len(key), STEP):
        k = key[lo : lo + STEP]
        w = k >> 6
        below = bits[w] & ((np.uint64(1) << (k & 63).astype(np.uint64)) - np.uint64(1))
        at[lo : lo + STEP] = rank[w] + np.bitwise_count(below)
    return found, at


class Level:
    """The distinct strings of one length in a block, in lexicographic order."""

    __slots__ = ("at", "keys", "last", "n", "parent", "symbol")


class Texts:
    """A block's texts as one run of bytes, each ended, and its strings level by level."""

    def __init__(self, raws: list[bytes]):
        joined = bytes([END]).join([*raws, b""]) if raws else b""
        self.bytes = np.frombuffer(joined, np.uint8)
        self.size = np.array([len(r) + 1 for r in raws], np.int64)
        self.start = np.cumsum(self.size) - self.size
        present = np.unique(self.bytes)
        self.alphabet = present
        code = np.zeros(256, np.uint8)
        code[present] = np.arange(len(present))
        self.code = code[self.bytes]

    def early(self, n: int) -> np.ndarray:
        """Positions whose string of n bytes would begin before the text."""
        if n < 2 or not len(self.size):
            return np.zeros(0, np.int64)
        offs = np.arange(n - 1)
        at = self.start[:, None] + offs
        return at[offs < self.size[:, None]]

    def levels(self, longest: int, named: bool = True) -> Iterator[tuple[Level, Level | None]]:
        """Each level with the one before; ``at`` has each position's string, ``n`` where there is none. ``keys`` are wanted only where strings are ``named``."""
        a, before = len(self.alphabet), None
        for n in range(1, longest + 1):
            level = Level()
            if before is None:
                at, slots = self.code.astype(np.int32), a
                level.parent, level.symbol = np.zeros(a, np.int32), self.alphabet
                level.keys = level.symbol.astype(np.uint64)
                level.at, level.n, level.last = at, slots, level.symbol.astype(np.int32)
            else:
                slots = before.n * a
                key = np.empty(len(self.code), np.int64 if slots > 2_000_000_000 else np.int32)
                key[:1] = slots
                np.multiply(before.at[:-1], a, out=key[1:], casting="unsafe")
                key[1:] += self.code[1:]
                key[self.early(n)] = slots
                found, level.at = _numbered(key, slots)
                del key
                level.n = len(found)
                level.parent, level.symbol = (found // a).astype(np.int32), self.alphabet[found % a]
                del found
                if named:
                    level.keys = before.keys[level.parent] << np.uint64(8) | level.symbol.astype(np.uint64)
                level.last = (before.last[level.parent] & 255) << 8 | level.symbol
            yield level, before
            before = level


def _route(last_two: np.ndarray, ranges: int) -> np.ndarray:
    """Range of contexts by their last two bytes."""
    return (last_two.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(ranges)


def _sent(level: Level, before: Level, ranges: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Order in which a block sends the strings of a level, and (range, from, to) in it."""
    to = _route(before.last[level.parent], ranges)
    order = np.argsort(to, kind="stable")
    to = to[order]
    first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
    return order, [(int(to[i]), int(i), int(j)) for i, j in zip(first, np.r_[first[1:], len(to)], strict=True)]


def _word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.array(list(map(xxhash.xxh3_64_intdigest, words)), np.uint64)


def _packed(longest: int, ranges: int, block_bytes: int):
    """Blocks of texts, and what each sends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 24
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            raws = [r or b"" for r in batch.column(2).cast(pa.binary()).to_pylist()]
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raws, strict=True):
                rows.append(row)
                held += len(row[2]) + 16
                if held >= block_bytes:
                    yield from block_rows(block, rows)
                    block, rows, held = block + 1, [], 0
        if rows:
            yield from block_rows(block, rows)

    def block_rows(block: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows.sort(key=lambda r: r[1])  # training texts first
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["block", "kind", "range", "seq", "a", "b"])

        table_ = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "held_out": pa.array([r[1] for r in rows], pa.bool_()), "text": pa.array([r[2] for r in rows], pa.large_binary())})
        step = max(1, len(rows) // max(1, sum(len(r[2]) for r in rows) // (4 << 20)))
        for seq, lo in enumerate(range(0, len(rows), step)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table_.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(table_.slice(lo, step))
            out.append((block, _DOC, 0, seq, sink.getvalue().to_pybytes(), None))
            yield batch()
        del table_
        n_train = sum(not r[1] for r in rows)
        counts: Counter = Counter()
        for r in rows[:n_train]:
            counts.update(r[2].lower().split())
        if n_train:
            counts[b""] = n_train  # the end
        others = set()
        for r in rows[n_train:]:
            others.update(r[2].lower().split())
        if n_train < len(rows):
            others.add(b"")
        counts.update(dict.fromkeys(others - counts.keys(), 0))
        keys, often = _word_hashes(list(counts)), np.fromiter(counts.values(), np.uint32, len(counts))
        del counts
        order = np.argsort(keys)
        keys, often = keys[order], often[order]
        edges = np.searchsorted(keys, (np.arange(1, ranges, dtype=np.uint64) << np.uint64(32)) // np.uint64(ranges) << np.uint64(32))
        for k, (i, j) in enumerate(zip(np.r_[0, edges], np.r_[edges, len(keys)], strict=True)):
            if j > i:
                out.append((block, _WORD, k, 0, _zip_sorted(keys[i:j]), _zip(often[i:j])))
        yield batch()
        texts = Texts([r[2] for r in rows])
        rows.clear()
        upto = int(texts.size[:n_train].sum())
        low = np.zeros(256 + 65536, np.int64)
        for n, (level, before) in enumerate(texts.levels(longest), 1):
            counted = np.zeros(level.n + 1, np.uint32)
            for lo in range(0, upto, SPAN):  # indices are made eight bytes wide
                counted += np.bincount(level.at[lo : min(lo + SPAN, upto)], minlength=level.n + 1).astype(np.uint32)
            counted = counted[: level.n]
            if n <= 2:
                low[level.keys.astype(np.int64) + (256 if n == 2 else 0)] = counted
            else:
                order, cuts = _sent(level, before, ranges)
                keys, counted = level.keys[order], counted[order]
                out += [(block, _GRAM, k, n, _zip_sorted(keys[i:j]), _zip(counted[i:j])) for k, i, j in cuts]
                if out:
                    yield batch()
        out.append((block, _LOW, 0, 0, _zip(low), None))
        yield batch()

    return run


def _added(t: pa.Table) -> pa.Table:
    """Counts of one range and length added up."""
    keys = np.concatenate([_unzip_sorted(a) for a in t.column("a").to_pylist()])
    often = np.concatenate([_unzip(b, np.uint32 if s == 0 else np.int64) for b, s in zip(t.column("b").to_pylist(), t.column("summed").to_pylist(), strict=True)]).astype(np.int64)
    if len(t) > 1:
        order = np.argsort(keys, kind="stable")
        keys, often = keys[order], often[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        keys, often = keys[first], np.add.reduceat(often, first) if len(first) else often
    keep = often > 0
    one = lambda name: t.column(name).slice(0, 1)
    return pa.table({"kind": one("kind"), "range": one("range"), "seq": one("seq"), "a": pa.array([_zip_sorted(keys[keep])], pa.binary()), "b": pa.array([_zip(often[keep])], pa.binary()), "summed": pa.array([1], pa.int32()), "total": pa.array([int(often.sum())]), "distinct": pa.array([int(keep.sum())])})


_ADDED = "kind int, range int, seq int, a binary, b binary, summed int, total long, distinct long"


def _looked_up(keys: np.ndarray, values: np.ndarray, sought: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(sought), values.dtype)
    at = np.minimum(np.searchsorted(keys, sought), len(keys) - 1)
    return np.where(keys[at] == sought, values[at], 0)


def _contexts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct contexts of sorted strings, and where each begins."""
    c = keys >> np.uint64(8)
    first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]]) if len(c) else np.zeros(0, np.int64)
    return c[first], first


def _statistics(keys: np.ndarray, often: np.ndarray, shorter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts and (n, d, X) of each, from their continuations' counts and the counts of these without the first byte."""
    c, first = _contexts(keys)
    if not len(c):
        return c, np.zeros((3, 0), np.int64)
    return c, np.stack([np.add.reduceat(often, first), np.diff(np.r_[first, len(keys)]), np.add.reduceat(shorter, first)])


def _answered(low: np.ndarray):
    """What each block gets back of a range: counts of its strings (a) and n, d, X of their contexts (b)."""

    def run(asked: pa.Table, model: pa.Table) -> pa.Table:
        known = {(k, s): (_unzip_sorted(a), _unzip(b, np.int64)) for k, s, a, b in zip(*(model.column(c).to_pylist() for c in ("kind", "seq", "a", "b")), strict=True)}
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        stats = {}
        for (kind, n), (keys, often) in known.items():
            if kind == _GRAM:
                tail = keys & np.uint64((1 << 8 * (n - 1)) - 1)
                shorter = low[256:][tail.astype(np.int64)] if n == 3 else _looked_up(*known.get((_GRAM, n - 1), none), tail)
                stats[n] = _statistics(keys, often, shorter)
        names = ["block", "kind", "range", "seq"]
        got = [asked.column(c).to_pylist() for c in names]
        a, b = [], []
        for kind, n, raw in zip(got[1], got[3], asked.column("a").to_pylist(), strict=True):
            keys = _unzip_sorted(raw)
            a.append(_zip(_looked_up(*known.get((kind, n), none), keys)))
            if kind == _GRAM and n in stats:
                c, s = stats[n]
                sought = _contexts(keys)[0]
                b.append(_zip(np.concatenate([_looked_up(c, x, sought) for x in s])))
            else:
                b.append(None)
        return pa.table({**{c: pa.array(v, pa.int64() if c == "block" else pa.int32()) for c, v in zip(names, got, strict=True)}, "a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def _log(x: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(x, 1e-300))


def _scored(longest: int, ranges: int, low: np.ndarray, tokens: int, types: int):
    """Scores of a block's texts."""
    two = low[256:].reshape(256, 256)
    # Order 0 and 1 from the table: n, d and X of the empty context and of single bytes.
    low_n = {0: np.array([low[:256].sum()]), 1: two.sum(axis=1)}
    low_d = {0: np.array([(low[:256] > 0).sum()]), 1: (two > 0).sum(axis=1)}
    low_x = {0: np.array([0]), 1: ((two > 0) * low[:256][None, :]).sum(axis=1)}
    floor = float(np.log10(1 / (tokens + types + 1)))

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        order = np.argsort(docs.column("seq").to_numpy())
        blobs = docs.column("a").to_pylist()
        rows = pa.concat_tables([pa.ipc.open_stream(blobs[i]).read_all() for i in order])
        del blobs
        raws = rows.column("text").to_pylist()
        replies = {}
        for kind, k, n, a, b in zip(*(answers.column(c).to_pylist() for c in ("kind", "range", "seq", "a", "b")), strict=True):
            replies[kind, n, k] = (a, b)
        base, n_tokens, n_known = words(raws, replies)
        texts = Texts(raws)
        del raws
        per = letters(texts, replies) / _LN10
        n = len(rows)
        return pa.table({"doc_id": rows.column("doc_id"), "held_out": rows.column("held_out"), "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()), "train_tokens": pa.array([tokens] * n, pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(per, pa.float64())})

    def words(raws: list[bytes], replies: dict) -> tuple[list, list, list]:
        distinct = {b""}
        for r in raws:
            distinct.update(r.lower().split())
        distinct = list(distinct)
        keys = _word_hashes(distinct)
        order = np.argsort(keys)
        edges = np.searchsorted(keys[order], (np.arange(1, ranges, dtype=np.uint64) << np.uint64(32)) // np.uint64(ranges) << np.uint64(32))
        often = np.zeros(len(distinct), np.int64)
        for k, (i, j) in enumerate(zip(np.r_[0, edges], np.r_[edges, len(keys)], strict=True)):
            if j > i:
                often[order[i:j]] = _unzip(replies[_WORD, 0, k][0], np.int64)
        value = dict(zip(distinct, np.where(often > 0, np.log10((often + 1) / (tokens + types + 1)), floor).tolist(), strict=True))
        base, n_tokens, n_known, end = [], [], [], value[b""]
        for r in raws:  # split again rather than kept: the words of a block take far more room than its text
            got = list(map(value.__getitem__, r.lower().split()))
            got.append(end)
            base.append(sum(got))
            n_tokens.append(len(got))
            n_known.append(len(got) - got.count(floor))
        return base, n_tokens, n_known

    def letters(texts: Texts, replies: dict) -> np.ndarray:
        """Natural log probability of each text."""
        total = np.zeros(len(texts.size))
        prob = rest = stat = None  # of the level before: log probability, the same once a longer context has excluded, and n, d, X of its contexts
        for n, (level, before) in enumerate(texts.levels(longest, named=False), 1):
            parent, symbol = level.parent, level.symbol
            if n == 1:
                count, (cn, cd, cx) = low[:256][symbol], (low_n[0], low_d[0], low_x[0])
            elif n == 2:
                first = before.symbol
                count, (cn, cd, cx) = two[first[parent], symbol], (low_n[1][first], low_d[1][first], low_x[1][first])
            else:
                order, cuts = _sent(level, before, ranges)
                count = np.zeros(level.n, np.int64)
                cn, cd, cx = np.zeros((3, before.n), np.int64)
                for k, i, j in cuts:
                    a, b = replies[_GRAM, n, k]
                    mine = order[i:j]
                    count[mine] = _unzip(a, np.int64)
                    if b:
                        p = parent[mine]
                        p = p[np.r_[True, p[1:] != p[:-1]]]
                        cn[p], cd[p], cx[p] = _unzip(b, np.int64).reshape(3, -1)
            # What the suffix offers: its string's place (tail), and its n and d.
            tail = None
            if n > 1:
                tail = np.zeros(level.n + 1, np.int32)
                for lo in range(0, len(level.at), SPAN):
                    tail[level.at[lo : lo + SPAN]] = before.at[lo : lo + SPAN]
            left, prob_here = np.empty(level.n), np.empty(level.n)
            for lo in range(0, level.n, STEP):
                some = slice(lo, min(lo + STEP, level.n))
                p, c = parent[some], count[some]
                n_, d_ = cn[p].astype(np.float64), cd[p].astype(np.float64)
                if n == 1:
                    # What a string has once its own context has failed: even shares of the bytes never seen.
                    left[some] = -np.log(256.0 - cd[0]) if cd[0] < 256 else 0.0
                    shorter = left[some]
                else:
                    t = tail[some]
                    up = before.parent[t]
                    # The suffix's n and d, those offered here excluded.
                    sn, sd = stat[0][up] - cx[p], stat[1][up] - cd[p]
                    below = stat[2][t]
                    whole = _log((sn + sd).astype(np.float64))
                    left[some] = np.where(below > 0, _log(below.astype(np.float64)) - whole, np.where(sd > 0, _log(sd.astype(np.float64)) - whole, 0.0) + rest[t])
                    shorter = prob[t]
                both = _log(n_ + d_)
                prob_here[some] = np.where(n_ > 0, np.where(c > 0, _log(c.astype(np.float64)) - both, _log(d_) - both + left[some]), shorter)
            del tail
            prob, rest, stat = prob_here, left, (cn, cd, count)
            if n < longest:  # texts' n-th bytes have no longer context
                have = texts.size >= n
                total[have] += prob[level.at[texts.start[have] + n - 1]]
        each = np.append(prob, 0.0)
        for lo in range(0, len(total), 256):
            some = texts.start[lo : lo + 256]
            upto = texts.start[lo + 256] if lo + 256 < len(total) else len(texts.bytes)
            total[lo : lo + 256] += np.add.reduceat(each[level.at[some[0] : upto]], some - some[0])
        return total

    return run


def scores(docs: DataFrame, held_out: F.Column, key: str = "doc_id", text: str = "text", order: int = ORDER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (words) and ``score`` (log10 probability of the text)."""
    longest = order + 1
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = int(max(48, size // (8 << 20)))
    packed = written(rows.mapInArrow(_packed(longest, ranges, block_bytes), _PACKED), "kind")
    sent = packed.where(F.col("kind").isin(_GRAM, _WORD))
    salt = F.floor(F.pmod(F.xxhash64("block"), F.lit(1 << 20)) % F.lit(max(1, int(size // block_bytes) // TOGETHER + 1)))
    one = sent.select("kind", "range", "seq", salt.alias("salt"), "a", "b", F.lit(0).alias("summed"))
    some = one.groupBy("kind", "range", "seq", "salt").applyInArrow(_added, _ADDED).drop("total", "distinct")
    model = written(some.groupBy("kind", "range", "seq").applyInArrow(_added, _ADDED))
    tokens, types = model.where(F.col("kind") == _WORD).agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    low = np.zeros(256 + 65536, np.int64)

    def lows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256 + 65536, np.int64)
        for batch in batches:
            for a in batch.column(0):
                total += _unzip(a.as_py(), np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    for r in packed.where(F.col("kind") == _LOW).select("a").mapInArrow(lows, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # 65,792 rows at most
        low[r["at"]] = r["n"]
    # Each range's model meets the blocks' questions, salted as before; the model goes to each salt.
    salts = max(1, int(size // block_bytes) // TOGETHER + 1)
    asked = sent.select("kind", "range", "seq", salt.cast("int").alias("salt"), "block", "a")
    copies = model.select("kind", "range", "seq", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "a", "b")
    answers = asked.groupBy("range", "salt").cogroup(copies.groupBy("range", "salt")).applyInArrow(_answered(low), "block long, kind int, range int, seq int, a binary, b binary")
    texts = packed.where(F.col("kind") == _DOC).select("block", "seq", "a")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scored(longest, ranges, low, tokens, types), schema)


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
