"""Byte-level BPE encoding with a hierarchical-bitmap queue of merge ranks, and decoding.

A pre-token starts as a linked list of its bytes. Each adjacent pair that the
vocabulary can merge is put in the bucket of its rank; a bitmap over the ranks
marks the buckets in use, with an upper level that marks its non-empty words, so
the next rank is found by find-first-set on two words however many ranks there
are. A bucket holds list positions; entries whose pair has changed
since are skipped. Each merge is constant work, so very long pre-tokens take
time linear in their length, plus the order of positions within a bucket.

Defined results: a null text counts as empty; an empty text has no ids; repeated
rows give repeated rows; an empty table gives an empty result; ids are those of
the rank file, special tokens are never made.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_of

#: Pre-tokens whose ids each Python worker remembers (twice as many at most), and the longest such (in characters).
REMEMBERED, REMEMBERED_LENGTH = 400_000, 48
#: Ranks of one word of the bitmap's lower level; bytes of pre-tokens that are merged together; and the id between them.
WORD, MERGED, APART = 9, 1 << 17, 1 << 31


class RankQueue:
    """Positions by merge rank; a word of the upper level marks the non-empty words of the lower one."""

    def __init__(self, ranks: int):
        self.low, self.top = [0] * ((ranks >> WORD) + 1), 0
        self.bucket: dict[int, list[int]] = {}

    def fill(self, ranks: list[int]) -> None:
        """Queue every position whose rank is not negative, in order."""
        bucket = self.bucket
        for i, r in enumerate(ranks):
            if r >= 0:
                held = bucket.get(r)
                if held is None:
                    self.open(r, i)
                else:
                    held.append(i)

    def open(self, rank: int, position: int) -> None:
        """Start the bucket of a rank."""
        self.bucket[rank] = [position]
        word = rank >> WORD
        self.low[word] |= 1 << (rank & ((1 << WORD) - 1))
        self.top |= 1 << word

    def take(self) -> tuple[int, list[int]]:
        """The least rank in use and its positions, in order; the bucket is emptied."""
        word = (self.top & -self.top).bit_length() - 1
        bits = self.low[word]
        rank = (word << WORD) + (bits & -bits).bit_length() - 1
        bits &= bits - 1
        self.low[word] = bits
        if not bits:
            self.top &= self.top - 1
        held = self.bucket.pop(rank)
        held.sort()
        return rank, held


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.token = {v: k for k, v in self.rank.items()}
        self.size = max(self.token) + 1
        self.byte = [self.rank.get(bytes([b]), -1) for b in range(256)]
        #: The id that two ids make together, by both in one key.
        self.joined = {x << 32 | y: r for t, r in self.rank.items() for i in range(1, len(t)) if (x := self.rank.get(t[:i])) is not None and (y := self.rank.get(t[i:])) is not None}
        self.text = {v: str(v) for v in self.token}
        self.pretokens = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.queue = RankQueue(self.size)

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of pre-tokens, which share one list and one queue: always the leftmost pair of the least rank is merged next.

        Pre-tokens are apart by an id that joins with none, so the order within
        each is what it would be alone.
        """
        ids, pair, ends = [APART], [-1], []
        joined, byte = self.joined.get, self.byte
        for p in pieces:
            own = [byte[b] for b in p]
            ids += own
            ids.append(APART)
            pair += [joined(x << 32 | y, -1) for x, y in zip(own, own[1:])]
            pair += (-1, -1) if own else (-1,)
            ends.append(len(ids) - 1)
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        queue = self.queue  # empty again when the merges are done
        queue.fill(pair)
        bucket, start = queue.bucket.get, queue.open
        while queue.top:
            r, held = queue.take()
            for at, i in enumerate(held):
                if pair[i] != r:
                    continue  # stale
                j = after[i]
                k, h, lowest = after[j], before[i], r
                ids[i], ids[j], pair[j] = r, -1, -1
                after[i] = k
                before[k] = i
                q = pair[i] = joined(r << 32 | ids[k], -1)
                if q >= 0:
                    found = bucket(q)
                    if found is None:
                        start(q, i)
                    else:
                        found.append(i)
                    if q < lowest:
                        lowest = q
                q = pair[h] = joined(ids[h] << 32 | r, -1)
                if q >= 0:
                    found = bucket(q)
                    if found is None:
                        start(q, h)
                    else:
                        found.append(h)
                    if q < lowest:
                        lowest = q
                if lowest < r:  # that rank goes first; the rest of this bucket waits
                    for x in held[at + 1 :]:
                        if pair[x] == r:
                            queue.bucket[r].append(x) if r in queue.bucket else start(r, x)
                    break
        out, begin = [], 1
        for end in ends:
            out.append([x for x in ids[begin:end] if x >= 0])
            begin = end + 1
        return out

    def learn(self, pretokens: set[str]) -> dict[str, tuple[int, ...]]:
        """Ids of the pre-tokens of some texts; short ones stay known."""
        known, older, rank, found, unknown = self.known, self.older, self.rank, {}, []
        for p in pretokens:
            ids = known.get(p)
            if ids is None:
                ids = older.get(p)
                if ids is None:
                    whole = rank.get(p.encode("utf-8", "surrogatepass"))
                    if whole is None:
                        unknown.append(p)
                        continue
                    ids = (whole,)
                known[p] = ids
            found[p] = ids
        at = 0
        while at < len(unknown):
            part, size = [], 0
            while at < len(unknown) and size < MERGED:
                part.append(unknown[at])
                size += len(unknown[at])
                at += 1
            for p, ids in zip(part, self.merge([p.encode("utf-8", "surrogatepass") for p in part])):
                found[p] = tuple(ids)
                if len(p) <= REMEMBERED_LENGTH:
                    known[p] = found[p]
        if len(known) >= REMEMBERED:  # what has been used since the last turn stays
            self.known, self.older = {}, known
        return found

    def encode_all(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text."""
        split = [self.pretokens(t) for t in texts]
        found = self.learn(set(chain.from_iterable(split)))
        for pretokens in split:
            yield list(chain.from_iterable(map(found.__getitem__, pretokens)))

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def decimals(self, ids: list[int]) -> str:
        return ",".join(map(self.text.__getitem__, ids))


@cache
def codec(path: str, pattern: str) -> Codec:
    """One codec for each Python worker and rank file."""
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) of every whole text. The rank file must be readable at ``path`` on every executor."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(bpe.encode_all(b.column(1).to_pylist())), pa.list_(pa.int32()))], [id_col, "ids"])

    return docs.select(F.col(id_col), text_of(docs, text_col).alias("t")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes) of every row of ids."""
    small_batches(encoded.sparkSession)
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(x or ()) for x in b.column(1).to_pylist()], pa.binary())], [id_col, "bytes"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, bytes binary")


def round_trip_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256; ids stay inside the task."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for b in batches:
            n, ids_sha, decoded_sha = [], [], []
            for ids in bpe.encode_all(b.column(1).to_pylist()):
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(bpe.decimals(ids).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col), text_of(docs, text_col).alias("t"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
