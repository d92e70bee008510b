"""Byte-level BPE by longest matches and backtracking, in time linear in the text.

A token sequence equals the merges' result if and only if each two adjacent
tokens are compatible, that is, encoding their joined bytes gives just the two.
So the encoder walks a piece with the longest token at each place (found by an
Aho-Corasick automaton over the bytes mapped to Latin-1 characters), accepts it
if it is compatible with the token before, tries its next shorter prefix
otherwise, and steps back where no prefix fits. Places known to lead nowhere
are marked, so that each is visited once per token length at most.

Nulls count as empty texts: no tokens, digests of the empty string. Rows with
the same or a null key each give their own row. Texts of any length are
encoded whole. Columns other than the key and the text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from geolode.llm.common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Bound the memory of a worker's tables of pieces already encoded and of pairs already compared, and of a step's texts.
MEMO, PAIRS, STEP_CHARS = 250_000, 700_000, 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


def merge_slowly(piece: bytes, ranks: dict[bytes, int], below: int | None = None) -> list[bytes]:
    """The merges' definition: join the adjacent pair of least rank, leftmost first, until none is known."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (below is None or r < below) and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Encoder:
    """Encodes pieces of text with given ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.size_of = {r: len(t) for t, r in ranks.items()}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.halves[rank] = None
            else:
                halves = merge_slowly(token, ranks, rank)
                if len(halves) != 2:
                    continue  # merges never make it; it stands only for a piece equal to it
                pair = (ranks[halves[0]], ranks[halves[1]])
                self.halves[rank] = pair
                self.joined[pair] = rank
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token) - 1))
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        for rank in self.halves:
            token = self.bytes_of[rank]
            for n in range(len(token) - 1, 0, -1):
                r = ranks.get(token[:n])
                if r is not None and r in self.halves:
                    self.shorter[rank] = r
                    break
        self.fits: dict[int, bool] = {}
        self.memo: dict[str, tuple[int, ...]] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border between two tokens.

        Undoes the merges of both from the latest on and asks at each point
        whether the two parts at the border would have been joined before.
        """
        key = left << 32 | right
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > PAIRS:
                self.fits.clear()
            known = self.fits[key] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        # ``until``: merges of rank at least this come after the state looked at.
        until = 1 << 62
        while True:
            whole = self.joined.get((left, right))
            if whole is not None and whole < until:
                return False
            ls, rs = self.halves[left], self.halves[right]
            if ls is None and rs is None:
                return True
            # The later of the two last merges is undone first. At equal ranks
            # the left one was made first, so the right one is undone.
            if rs is None or (ls is not None and left > right):
                until, left = left, ls[1]
            else:
                # A crossing pair of the same rank stands left of it and would win.
                until, right = right + 1, rs[0]

    def merged(self, piece: bytes) -> list[int]:
        """Ids of a piece's bytes as the merges give them."""
        text = piece.decode("latin-1")
        n = len(text)
        longest = [-1] * n
        for end, (rank, back) in self.automaton.iter(text):
            longest[end - back] = rank  # ends rise, so the last one is the longest
        ids: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0] if n else -1
        size, shorter, known, compatible = self.size_of, self.shorter, self.fits, self.compatible
        last = -1
        while at < n:
            end = at + size[token]
            if not dead[end]:
                fits = last < 0 or known.get(last << 32 | token)
                if fits is None:
                    fits = compatible(last, token)
                if fits:
                    ids.append(token)
                    at, last = end, token
                    token = longest[at] if at < n else -1
                    continue
            nxt = shorter.get(token)
            while nxt is None:
                dead[at] = 1
                token = ids.pop()
                last = ids[-1] if ids else -1
                at -= size[token]
                nxt = shorter.get(token)
            token = nxt
        return ids

    def piece(self, piece: str) -> tuple[int, ...]:
        ids = self.memo.get(piece)
        if ids is None:
            raw = piece.encode("utf-8", "replace")
            whole = self.ranks.get(raw)
            ids = (whole,) if whole is not None else tuple(self.merged(raw))
            if len(self.memo) >= MEMO:
                self.memo.clear()
            if len(raw) <= 64:
                self.memo[piece] = ids
        return ids

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_encoders: dict[str, Encoder] = {}


def encoder_of(packed: bytes) -> Encoder:
    """One encoder per worker process and vocabulary."""
    key = hashlib.sha256(packed).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in packed.split(b"\n") if x)}
        _encoders[key] = Encoder(ranks)
    return _encoders[key]


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes each text and decodes its ids again.

    Returns the key, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, with
    ``with_ids``, the ids. The rank file is read on the driver and sent along,
    so executors need no copy; its size does not grow with the data.
    """
    spark = docs.sparkSession
    with open(path, "rb") as f:
        packed = spark.sparkContext.broadcast(f.read())
    fields = [T.StructField(key, docs.schema[key].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        enc = encoder_of(packed.value)
        find = regex.compile(pattern).findall
        names = {i: str(i) for i in enc.bytes_of}
        sha, name, size = hashlib.sha256, names.__getitem__, len
        for keys, texts in steps(batches):
            counts, digests, back, all_ids = [], [], [], []
            for value in texts:
                ids: list[int] = []
                get, full = enc.memo.get, enc.piece
                for p in find(value or ""):
                    ids.extend(get(p) or full(p))
                counts.append(size(ids))
                digests.append(sha(",".join(map(name, ids)).encode()).hexdigest())
                back.append(sha(enc.decode(ids)).hexdigest())
                if with_ids:
                    all_ids.append(np.array(ids, np.int32))
            columns = [keys, pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(back, pa.string())]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), pa.array(np.concatenate([*all_ids, np.zeros(0, np.int32)]))))
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list]]:
        """A megabyte of text at a time, so that the ids of a whole batch never stand in memory."""
        for batch in batches:
            lo, held = 0, 0
            ends = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()
            for i, n in enumerate(ends):
                held += n
                if held >= STEP_CHARS or i + 1 == len(ends):
                    yield batch.column(0).slice(lo, i + 1 - lo), batch.column(1).slice(lo, i + 1 - lo).to_pylist()
                    lo, held = i + 1, 0

    return docs.select(key, text).mapInArrow(rows, T.StructType(fields))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
