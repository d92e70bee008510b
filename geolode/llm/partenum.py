"""N-gram Jaccard join by PartEnum signatures.

A text is the set of its word shingles. Two sets whose Jaccard similarity
reaches the threshold differ in at most ``k`` shingles, a bound that follows
from the size of either. So the domain of shingles is cut into more than ``k``
partitions: sets that differ in ``k`` shingles agree on all partitions but
``k``, and the set's contents in a partition, hashed, are a signature. Subsets
of partitions are not enumerated, nor are there two levels of them: single
partitions with the prefix rule below find the same pairs. Sizes are put
in bands of factor four, each with its own partitions; a set whose larger
partners may lie in the next band has signatures there too, so that similar
sets share a band.

Of a set's signatures, the ``k + 1`` rarest are enough if all sets use one
order (two sets that agree on all but ``k`` must share one of these). The order
is by a sketch of how often signatures occur, of fixed size, then by hash, so
passages that many texts share make no candidates unless a text is made of
them. Signatures that occur once are left out, as nothing can share them.

Steps: (1) sizes, set hashes, profiles and the sketch, one pass; texts with
equal sets are one class from here on; (2) signatures, packed by hash range;
each range gives the pairs of small groups, and larger groups by name; (3)
profiles (how many shingles lie in each of some cells) that differ by more than
the sets may rule a pair out; what is left, in a larger group a spanning forest
of it, is connected into candidate clusters (of groups beyond 4096 sets every
member is, with no profiles looked at); (4) exact overlaps inside each
cluster by products of incidence matrices, clusters dealt in pairs of blocks of
bounded size, each giving a spanning forest of true links; (5) components of
those. No partner is ever left out: bounds are on the size of a task's input
and on how a group is written down only.

Words are ASCII-lower-cased runs without ASCII white space. Nulls and texts
without words have the empty set and link with nothing; a text shorter than a
shingle has one, the whole sequence. Rows with equal ids each give a row; a
null id is a row like others and never a component's id unless all are null.
Empty tables give empty results, other columns are ignored. Shingles and sets
are told apart by hashes of 52 and 64 bits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolode.llm.common import table, written
from geolode.llm.components import components

WORDS, PERCENT = 5, 75
#: Counters of the sketch; it is sent to every worker and does not grow.
COUNTERS, SLICES = 1 << 22, 32
#: Sets in one block of a cluster.
BLOCK = 1024
#: Bits that say which texts are in clusters, sent to every worker.
BITS = 1 << 25
#: Fewest cells of a profile; groups of up to so many sets are written as pairs; up to so many are compared by profile.
CELLS, PAIRED, BOUNDED = 128, 8, 4096
_FLUSH, _SOME_BYTES = 400_000, 3 << 20
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Hashes of words, forgotten when there are very many."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class Sets:
    """The shingle sets of some texts, one after the other: hashes of 52 bits, rising in each set."""

    def __init__(self, raws: list[bytes | None], words: dict, n: int = WORDS):
        parts = [raw.lower().split() if raw else [] for raw in raws]  # bytes: A-Z and ASCII white space only
        count = np.array([len(p) for p in parts], np.int64)
        total = int(count.sum())
        h = np.fromiter(map(words.__getitem__, chain.from_iterable(parts)), np.uint64, total)
        del parts
        begin = np.cumsum(count) - count
        doc = np.repeat(np.arange(len(raws), dtype=np.uint64), count)
        rolled = []
        if total >= n:
            whole = _mix(h[: total - n + 1] + np.uint64(n))
            for i in range(1, n):
                whole = _mix(whole + h[i : total - n + 1 + i] * _A)
            inside = np.arange(total - n + 1) + n <= (begin + count)[doc[: total - n + 1].astype(np.int64)]
            rolled.append(doc[: total - n + 1][inside] << np.uint64(52) | whole[inside] >> np.uint64(12))
        short = []
        for i in np.flatnonzero((count > 0) & (count < n)):  # the whole sequence
            w = h[begin[i] : begin[i] + count[i]]
            x = _mix(w[:1] + np.uint64(len(w)))
            for k in range(1, len(w)):
                x = _mix(x + w[k : k + 1] * _A)
            short.append(np.uint64(i) << np.uint64(52) | x[0] >> np.uint64(12))
        rolled.append(np.array(short, np.uint64))
        v = np.concatenate(rolled)
        v.sort()
        if len(v):
            v = v[np.r_[True, v[1:] != v[:-1]]]
        self.doc = (v >> np.uint64(52)).astype(np.int64)
        self.s = v & np.uint64((1 << 52) - 1)
        self.size = np.bincount(self.doc, minlength=len(raws))
        self.start = np.cumsum(self.size) - self.size
        self.hash = np.zeros(len(raws), np.int64)
        full = np.flatnonzero(self.size)
        if len(full):
            x = np.add.reduceat(_mix(self.s + _A), self.start[full]) + self.size[full].astype(np.uint64)
            self.hash[full] = _mix(_mix(x)).view(np.int64)

    def profiles(self) -> list[bytes]:
        """How many shingles of each set lie in each cell, 255 at most; about a cell for four shingles.

        Two sets differ by at least as much as their profiles, or these folded.
        """
        cells = np.maximum(CELLS, 1 << np.frexp(np.maximum(self.size - 1, 1) / 4)[1].astype(np.int64))
        begin = np.cumsum(cells) - cells
        at = begin[self.doc] + ((self.s >> np.uint64(20)) * cells[self.doc].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        counts = np.minimum(np.bincount(at, minlength=int(cells.sum())), 255).astype(np.uint8)
        return [counts[i : i + n].tobytes() for i, n in zip(begin.tolist(), cells.tolist(), strict=True)]

    def one(self, i: int) -> bytes:
        return self.s[self.start[i] : self.start[i] + self.size[i]].tobytes()

    def signatures(self, chosen: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(set, signature) of the chosen sets in each band that they are in: a hash of a set's contents in each partition not empty.

        Where so many shingles fell together that no more partitions are filled
        than sets may differ by, the empty ones sign as well: agreement may lie there.
        """
        own, upper = _band(self.size), _band(self.size * 100 // percent)
        for bands, these in ((own, chosen), (upper, chosen & (upper > own))):
            if not these.any():
                continue
            parts = np.maximum(1024, (4 << 2 * bands) * 4 // 5).astype(np.uint64)
            salt = (bands + 1).astype(np.uint64) * _C
            take = these[self.doc]
            doc, s = self.doc[take], self.s[take]
            at = (s >> np.uint64(20)) * parts[doc] >> np.uint64(32)  # rises with the hash, so contents are runs
            first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])])
            doc, at = doc[first], at[first]
            sig = _mix(np.add.reduceat(_mix(s), first) + _mix(at + salt[doc]))
            filled = np.bincount(doc, minlength=len(self.size))
            for i in np.flatnonzero(these & (filled <= differences(self.size, percent))):
                rest = np.setdiff1d(np.arange(int(parts[i]), dtype=np.uint64), at[doc == i])
                sig = np.r_[sig, _mix(rest + salt[i] + _A)]
                doc = np.r_[doc, np.full(len(rest), i)]
            yield doc, sig


def _band(size: np.ndarray) -> np.ndarray:
    """Bands of factor four."""
    return (np.frexp(np.maximum(size, 1).astype(np.float64))[1] - 1) // 2


def differences(size: np.ndarray, percent: int) -> np.ndarray:
    """Most shingles by which a set of this size and one similar enough can differ."""
    return size * (100 - percent) // percent


def _some(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[bytes | None]]]:
    """Ids and texts, about half a megaword at a time, since work is by whole arrays."""
    for batch in batches:
        raws = batch.column(1).cast(pa.binary()).to_pylist()
        lo, held = 0, 0
        for i, raw in enumerate(raws):
            held += len(raw or b"") + 64
            if held >= _SOME_BYTES or i - lo == 4000 or i + 1 == len(raws):
                yield batch.column(0).slice(lo, i + 1 - lo), raws[lo : i + 1]
                lo, held = i + 1, 0


def _new(sets: Sets, seen: set) -> np.ndarray:
    """Sets of three shingles or more (smaller ones link with their equals only) that this task has not met."""
    chosen = np.zeros(len(sets.size), bool)
    if len(seen) > 1_000_000:
        seen.clear()
    for i in np.flatnonzero(sets.size > 2).tolist():
        h = int(sets.hash[i])
        if h not in seen:
            seen.add(h)
            chosen[i] = True
    return chosen


def _counted(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        words, seen = _Words(), set()
        sketch, waiting, held = np.zeros(COUNTERS, np.int32), [], 0
        names = ["doc_id", "n", "h", "t", "x", "profile", "slice", "salt", "counts"]
        salt = 0
        for ids, raws in _some(batches):
            sets = Sets(raws, words)
            for _, sig in sets.signatures(_new(sets, seen), percent):
                waiting.append((sig % np.uint64(COUNTERS)).astype(np.int32))
                held += len(sig)
            if held > COUNTERS:
                sketch += np.bincount(np.concatenate(waiting), minlength=COUNTERS).astype(np.int32)
                waiting, held = [], 0
            salt ^= len(raws) + len(sets.s)
            n = len(raws)
            profiles = sets.profiles()
            t = [xxhash.xxh3_64_intdigest(r or b"") - (1 << 63) for r in raws]
            x = np.array([xxhash.xxh64_intdigest(r or b"", 42) for r in raws], np.uint64).view(np.int64)  # as Spark's xxhash64 has it
            none = pa.nulls(n, pa.int32())
            yield pa.RecordBatch.from_arrays([ids, pa.array(sets.size, pa.int64()), pa.array(sets.hash), pa.array(t, pa.int64()), pa.array(x), pa.array(profiles, pa.binary()), none, none, pa.nulls(n, pa.binary())], names)
        if waiting:
            sketch += np.bincount(np.concatenate(waiting), minlength=COUNTERS).astype(np.int32)
        no = pa.nulls(1, pa.int64())
        for k, part in enumerate(np.split(sketch, SLICES)):
            if part.any():
                yield pa.RecordBatch.from_arrays([no, no, no, no, no, pa.nulls(1, pa.binary()), pa.array([k], pa.int32()), pa.array([salt & 0xFF], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)])], names)

    return run


def _summed(t: pa.Table) -> pa.Table:
    total = np.zeros(COUNTERS // SLICES, np.int64)
    for c in t.column("counts"):
        total += np.frombuffer(zlib.decompress(c.as_py()), np.int32)
    top = np.minimum(total, (1 << 31) - 1).astype(np.int32)
    return pa.table({"slice": t.column("slice").slice(0, 1), "counts": pa.array([zlib.compress(top.tobytes(), 1)])})


def _candidates(docs: DataFrame, sketch: np.ndarray, n_ranges: int, percent: int) -> DataFrame:
    """(``a``, ``b``, ``star``): what shares a signature. 0: a pair of sets; 1: a larger group's name and a member; 2: the least member of a group that is larger still, and another."""
    said = docs.sparkSession.sparkContext.broadcast(zlib.compress(sketch.tobytes(), 1))
    names = ["range", "sigs", "sets"]

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.frombuffer(zlib.decompress(said.value), np.int32)
        words, seen, sigs, owners, held = _Words(), set(), [], [], 0

        def flush() -> pa.RecordBatch:
            sig, own = np.concatenate(sigs), np.concatenate(owners)
            at = ((sig >> np.uint64(32)) * np.uint64(n_ranges)) >> np.uint64(32)
            order = np.argsort(at, kind="stable")
            at, sig, own = at[order], sig[order], own[order]
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            cut = list(zip(first, np.r_[first[1:], len(at)], strict=True))
            sigs.clear()
            owners.clear()
            return pa.RecordBatch.from_arrays([pa.array(at[first].astype(np.int32)), pa.array([sig[i:j].tobytes() for i, j in cut]), pa.array([own[i:j].tobytes() for i, j in cut])], names)

        for _, raws in _some(batches):
            sets = Sets(raws, words)
            most = differences(sets.size, percent) + 1
            for doc, sig in sets.signatures(_new(sets, seen), percent):
                count = often[(sig % np.uint64(COUNTERS)).astype(np.int64)]
                key = doc.astype(np.uint64) << np.uint64(52) | np.minimum(count, 0xFFFF).astype(np.uint64) << np.uint64(36) | sig >> np.uint64(28)
                order = np.argsort(key)
                doc, sig, count = doc[order], sig[order], count[order]
                filled = np.bincount(doc, minlength=len(raws))
                place = np.arange(len(doc)) - (np.cumsum(filled) - filled)[doc]
                rare = (place < np.where(filled > sets.size, filled, most)[doc]) & (count > 1)
                sigs.append(sig[rare])
                owners.append(sets.hash[doc[rare]])
                held += int(rare.sum())
            if held > _FLUSH:
                yield flush()
                held = 0
        if held:
            yield flush()

    def grouped(t: pa.Table) -> pa.Table:
        sig = np.frombuffer(b"".join(t.column("sigs").to_pylist()), np.uint64)
        own = np.frombuffer(b"".join(t.column("sets").to_pylist()), np.int64)
        order = np.lexsort((own, sig))
        sig, own = sig[order], own[order]
        new = np.r_[True, (sig[1:] != sig[:-1]) | (own[1:] != own[:-1])]
        sig, own = sig[new], own[new]
        first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        many = np.diff(np.r_[first, len(sig)])
        place = np.arange(len(sig)) - np.repeat(first, many)
        group = np.repeat(many, many)
        pairs = []
        for step in range(1, PAIRED):  # members at this distance in their group
            i = np.flatnonzero((group <= PAIRED) & (place + step < group))
            pairs.append(np.stack([own[i], own[i + step], np.zeros(len(i), np.int64)]))
        i = np.flatnonzero((group > BOUNDED) & (place > 0))
        pairs.append(np.stack([own[i - place[i]], own[i], np.full(len(i), 2)]))
        i = np.flatnonzero((group > PAIRED) & (group <= BOUNDED))
        if len(i):  # equal groups, of which there are many, share a name
            begin = np.flatnonzero(place[i] == 0)
            name = _mix(np.add.reduceat(_mix(own[i].view(np.uint64) + _B), begin)).view(np.int64)
            pairs.append(np.stack([np.repeat(name, group[i][begin]), own[i], np.ones(len(i), np.int64)]))
        a, b, star = np.unique(np.concatenate(pairs, axis=1), axis=1)
        return pa.table({"a": pa.array(a), "b": pa.array(b), "star": pa.array(star.astype(np.int32))})

    rows = docs.mapInArrow(signed, "range int, sigs binary, sets binary")
    found = rows.groupBy("range").applyInArrow(grouped, "a long, b long, star int")
    return found.groupBy("a", "b").agg(F.max("star").alias("star"))


def _folded(profiles: np.ndarray, cells: int) -> np.ndarray:
    """Rows of profiles with neighbouring cells added up."""
    return profiles if profiles.shape[1] == cells else profiles.reshape(len(profiles), cells, -1).sum(axis=2)


def _by_length(profiles: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length: (where profiles of it stand, their rows)."""
    size = np.array([len(p) for p in profiles])
    return {int(n): (i := np.flatnonzero(size == n), np.frombuffer(b"".join(profiles[k] for k in i), np.uint8).reshape(len(i), -1).astype(np.int16)) for n in np.unique(size)}


def _gaps(one: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Differences of a profile and others that all have one length."""
    cells = min(len(one), rows.shape[1])
    return np.abs(_folded(rows, cells) - _folded(one[None, :], cells)).sum(axis=1, dtype=np.int64)


def _near_enough(percent: int):
    """Pairs whose profiles differ by no more than sets of their sizes may."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
                left, right = batch.column(4).to_pylist(), batch.column(5).to_pylist()
                gap = np.zeros(batch.num_rows, np.int64)
                for n, (i, rows) in _by_length(left).items():
                    for m, (j, others) in _by_length([right[k] for k in i]).items():
                        cells = min(n, m)
                        for lo in range(0, len(j), 4096):
                            some = slice(lo, lo + 4096)
                            gap[i[j[some]]] = np.abs(_folded(rows[j[some]], cells) - _folded(others[some], cells)).sum(axis=1, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array((100 + percent) * gap <= (100 - percent) * (na + nb)))

    return run


def _near_groups(percent: int):
    """A spanning forest of the pairs of a group whose profiles are near enough, found breadth first."""

    def run(t: pa.Table) -> pa.Table:
        h, n, profiles = t.column("h").to_numpy(), t.column("n").to_numpy(), t.column("profile").to_pylist()
        rest, a, b = _by_length(profiles), [], []
        while rest:
            start = next(iter(rest))
            at, rows = rest[start]
            todo = [int(at[0])]
            rest[start] = at[1:], rows[1:]
            while todo:
                i = todo.pop()
                one = np.frombuffer(profiles[i], np.uint8).astype(np.int16)
                for k, (at, rows) in list(rest.items()):
                    near = np.zeros(len(at), bool)
                    for lo in range(0, len(at), 2048):
                        some = slice(lo, lo + 2048)
                        near[some] = (100 + percent) * _gaps(one, rows[some]) <= (100 - percent) * (n[at[some]] + n[i])
                    if near.any():
                        a += [h[i]] * int(near.sum())
                        b += h[at[near]].tolist()
                        todo += at[near].tolist()
                        rest[k] = at[~near], rows[~near]
                rest = {k: v for k, v in rest.items() if len(v[0])}
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _flags(nodes: DataFrame) -> np.ndarray:
    """A bit for each cluster member's hash: a filter of fixed size, or-ed on the executors in parts of 32 slices."""
    size = BITS // 8 // 32

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b.column(0).to_numpy() for b in batches]
        at = np.unique((np.concatenate(got) if got else np.zeros(0, np.int64)) % BITS)
        for k in np.unique(at // (size * 8)).tolist():
            bits = np.zeros(size * 8, bool)
            bits[at[at // (size * 8) == k] - k * size * 8] = True
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)])], ["slice", "bits"])

    def ored(t: pa.Table) -> pa.Table:
        total = np.zeros(size, np.uint8)
        for c in t.column("bits"):
            total |= np.frombuffer(zlib.decompress(c.as_py()), np.uint8)
        return pa.table({"slice": t.column("slice").slice(0, 1), "bits": pa.array([zlib.compress(total.tobytes(), 1)])})

    out = np.zeros((32, size), np.uint8)
    for r in nodes.mapInArrow(gathered, "slice int, bits binary").groupBy("slice").applyInArrow(ored, "slice int, bits binary").collect():
        out[r.slice] = np.frombuffer(zlib.decompress(bytes(r.bits)), np.uint8)
    return out.ravel()


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, from products of incidence matrices over the shingles that two sets share at least."""
    own = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    value, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often[column] > 1
    own, column = own[shared], np.unique(column[shared], return_inverse=True)[1]
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    own, column = own[order], column[order]
    width = max(1, (1 << 23) // len(sets))
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        i, j = np.searchsorted(column, [lo, lo + width])
        part = np.zeros((len(sets), min(width, int(column[-1]) + 1 - lo)), np.float32)
        part[own[i:j], column[i:j] - lo] = 1
        out += part @ part.T
    return out


def _verified(percent: int):
    def run(t: pa.Table) -> pa.Table:
        left, right = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        ids, sides, raw = t.column("h").to_numpy(), t.column("side").to_numpy(), t.column("shingles").to_pylist()
        _, one = np.unique(ids, return_index=True)
        ids, sides = ids[one], sides[one]
        sets = [np.frombuffer(raw[k], np.uint64) for k in one]
        size = np.array([len(s) for s in sets])
        both = overlaps(sets)
        hits = 100 * both >= percent * (size[:, None] + size[None, :] - both)
        np.fill_diagonal(hits, False)
        if left != right:
            hits &= sides[:, None] != sides[None, :]
        label = np.arange(len(ids))
        while True:
            new = np.minimum(label, np.where(hits, label[None, :], len(ids)).min(axis=1))
            new = new[new]
            if (new == label).all():
                break
            label = new
        some = np.flatnonzero(label != np.arange(len(ids)))
        return pa.table({"a": pa.array(ids[label[some]]), "b": pa.array(ids[some])})

    return run


def _links(docs: DataFrame, classes: DataFrame, cluster: DataFrame, percent: int) -> DataFrame:
    """A spanning forest (``a``, ``b``) of the true links inside clusters (``node``, ``root``).

    The texts to read again are known by a hash of one text for each class
    (``t``), looked up among bits, so that no other text is taken apart.
    """
    sought = classes.join(cluster, F.col("h") == F.col("node")).select("t")
    flags = docs.sparkSession.sparkContext.broadcast(zlib.compress(_flags(sought).tobytes(), 1))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(zlib.decompress(flags.value), np.uint8)
        import xxhash

        words, seen = _Words(), set()
        for batch in batches:
            raws = []
            for raw in batch.column(1).cast(pa.binary()).to_pylist():
                at = (xxhash.xxh3_64_intdigest(raw or b"") - (1 << 63)) % BITS
                if bits[at >> 3] >> (7 - (at & 7)) & 1:
                    raws.append(raw)
            for lo in range(0, len(raws), 500):
                sets = Sets(raws[lo : lo + 500], words)
                some = np.flatnonzero(_new(sets, seen))
                yield pa.RecordBatch.from_arrays([pa.array(sets.hash[some]), pa.array([sets.one(i) for i in some], pa.binary())], ["h", "shingles"])

    blocks = cluster.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    where = cluster.join(blocks, "root").select(F.col("node").alias("h"), "root", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("mine"))
    where = where.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    where = where.select("h", "root", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).cast("int").alias("side"))
    sets = docs.mapInArrow(members, "h long, shingles binary")
    return sets.join(where, "h").groupBy("root", "i", "j").applyInArrow(_verified(percent), "a long, b long")


def _classed(docs: DataFrame, percent: int, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(``doc_id``, ``n``, ``h``, ``x``) of each row, ``x`` being Spark's hash of the text, and (``h``, ``least``, ``root``) of each class of equal sets."""
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    first = written(texts.mapInArrow(_counted(percent), "doc_id long, n long, h long, t long, x long, profile binary, slice int, salt int, counts binary"))
    sketch = np.zeros((SLICES, COUNTERS // SLICES), np.int32)
    parts = first.where("slice is not null").select("slice", "salt", "counts")
    parts = parts.groupBy("slice", "salt").applyInArrow(_summed, "slice int, counts binary").groupBy("slice").applyInArrow(_summed, "slice int, counts binary")
    for r in parts.collect():  # as many rows as slices
        sketch[r.slice] = np.frombuffer(zlib.decompress(bytes(r.counts)), np.int32)
    rows = first.where("slice is null").select("doc_id", "n", "h", "x")
    sets = first.where("slice is null and n > 2").groupBy("h").agg(F.max(F.struct("t", "n", "profile")).alias("s")).select("h", "s.*")
    total = rows.agg(F.sum("n")).first()[0] or 0
    ranges = int(max(64, total // 500_000))
    pairs = _candidates(texts, sketch.ravel(), ranges, percent)
    pairs = written(pairs, "star")
    side = lambda x: sets.select(F.col("h").alias(x), F.col("n").alias(f"n{x}"), F.col("profile").alias(f"p{x}"))
    two = pairs.where("star = 0").join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "pa", "pb")
    group = pairs.where("star = 1").select("a", F.col("b").alias("h")).join(sets.select("h", "n", "profile"), "h")
    near = two.mapInArrow(_near_enough(percent), "a long, b long").unionByName(group.groupBy("a").applyInArrow(_near_groups(percent), "a long, b long"))
    cluster = components(near.unionByName(pairs.where("star = 2").select("a", "b")))
    root = components(_links(texts, sets.select("h", "t"), cluster, percent))
    least = rows.where("n > 0").groupBy("h").agg(F.min("doc_id").alias("least"))
    classes = written(least.join(root.withColumnRenamed("node", "h"), "h", "left").select("h", "least", F.coalesce("root", "h").alias("root")))
    return rows, classes


def jaccard_components(docs: DataFrame, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: ``doc_id``, ``n_shingles``, ``component_id`` (least id reachable by links)."""
    rows, classes = _classed(docs, percent, key, text)
    lowest = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    label = classes.join(lowest, "root").select("h", "component_id")
    alone = F.when(F.col("n") > 0, F.col("h"))  # null: joins with nothing
    out = rows.withColumn("h", alone).join(label, "h", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("h").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def deduplicated(docs: DataFrame, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component.

    That of least id stays (rows without id come last), of rows with that id the
    one whose text has the least hash, and of rows equal in both the one whose
    columns have the least hash. Rows of one id with unlike texts are documents of their own. Rows
    without words link with nothing and all stay.
    """
    rows, classes = _classed(docs, percent, key, text)
    each = rows.where("n > 0").join(classes.select("h", "root"), "h")
    first = each.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "x")).alias("s")).select("s.doc_id", "s.x")
    copies = rows.where("n > 0").groupBy("doc_id", "x").agg(F.count("*").alias("copies"))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["x"] == b["x"])
    kept = first.join(copies, same(first, copies)).select(first["doc_id"].alias("__id"), first["x"].alias("__x"), "copies")
    kept = written(kept.unionByName(rows.where("n = 0").select(F.col("doc_id").alias("__id"), F.col("x").alias("__x"), F.lit(1).cast("long").alias("copies")).distinct()))
    hashed = docs.withColumn("__h", F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    found = hashed.join(kept, F.col(f"`{key}`").cast("long").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__x")))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    whole = F.struct(*columns)
    one = found.where("copies > 1").groupBy("__id", "__x").agg(F.min_by(whole, F.xxhash64(*columns)).alias("row")).select("row.*")
    return found.where("copies = 1").select(*columns).unionByName(one)


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [md5(array_to_string(words, ' '))]
    ELSE list_transform(range(1, len(words) - 3), lambda i: md5(array_to_string(words[i:i+4], ' '))) END) AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
x AS (SELECT doc_id, unnest(sh) AS g FROM s),
-- a shingle of the first quarter and one by a fixed order: links must share one of these
p AS (SELECT doc_id, g FROM (SELECT x.doc_id, g, row_number() OVER (PARTITION BY x.doc_id ORDER BY c, g) AS k, n.n FROM x JOIN (SELECT g, count(*) AS c FROM x GROUP BY g) USING (g) JOIN n ON n.doc_id = x.doc_id) WHERE k <= n - ceil(n * 0.75) + 1),
cand AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b USING (g) JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id WHERE a.doc_id < b.doc_id AND na.n * 4 >= nb.n * 3 AND nb.n * 4 >= na.n * 3),
link AS (SELECT a, b FROM (SELECT c.a, c.b, count(*) AS i FROM cand c JOIN x xa ON xa.doc_id = c.a JOIN x xb ON xb.doc_id = c.b AND xb.g = xa.g GROUP BY c.a, c.b)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 75 * (na.n + nb.n - i)),
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, r.c AS component_id FROM n JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = n.doc_id
"""
