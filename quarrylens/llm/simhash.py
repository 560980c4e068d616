"""SimHash near-duplicates joined by Golay-code fuzzy keys.

Fingerprints of 64 bits are cut into three segments (22, 21 and 21 bits). Two
fingerprints at most two bits apart agree wholly in one segment and differ by at
most one bit in the segment after it (cyclically), whichever way the errors
fall. So each fingerprint gets, for each segment, keys of the segment itself and
the indices of the Golay codewords nearest to the next segment and to the words
one bit from that. Words one bit apart always share such an index: a bucket of
equal keys holds every pair that can link. Buckets verify their members by
exact Hamming distance and return spanning links only, never all pairs.

Documents with the same fingerprint meet once, as one fingerprint.

Defined results: a null text counts as empty; a text without words has the
fingerprint zero and is linked like any other; an empty table gives an empty
result; rows with a null id keep a row, and take a component like others (null
only if no id in the component is known); repeated rows give repeated rows.

:func:`keep_one` removes near copies by what their texts share: links are pairs
whose sets of ``SIMILAR_WORDS``-word shingles have a Jaccard similarity of
``SIMILARITY`` or more, counted exactly. Sets whose fingerprints link by Golay keys are
verified as they span: texts may share a fingerprint and little else, such as a
line that repeats. Sets at the bound of similarity differ in too many bits of a fingerprint
(some 19 of 128) for Golay keys at any bearable number of them. These are
found beside by bands of min-hashes, ``BANDS`` keys of ``BAND_ROWS`` each;
two sets of one bucket are verified if their sizes allow the similarity and their
min-hashes do: one bit of each of 128 differs in ``SEARCH_BITS`` at most. Texts are
one only if their shingle sets are equal (by a hash of 128 bits).

A bucket of up to ``FEW`` sets is compared within a task. In any larger one a
member, its centre, first meets all others by a join; verified links make groups. The
members outside of a bucket's largest group are then compared with all others in
blocks of ``BLOCK``, two blocks in a task, by the bits of their shingles. So no task
holds a bucket, pairs are no rows, a bucket of one group is done, and any two members
of a bucket have been compared or are of one group. The comparisons of sets that are
nearly, but not quite, similar still grow with the square of their number. In the
result, rows with a null id have no name to be dropped by and stay, and rows that
share the smallest id of a group all stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget, free_shuffles, scratch, small_batches, text_of
from .golay import near_indices
from .graph import connected_components

SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Differing bits at which fingerprints link; the segments are made for two.
MAX_BITS = 2
SEED = 42
#: A larger bucket is linked by shared one-bit variants instead of a distance matrix, so many of them at a time.
MATRIX, VARIANTS = 512, 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)

#: What makes two texts near copies for :func:`keep_one`.
SIMILAR_WORDS, SIMILARITY = 5, 0.8
#: Bands of a set's min-hashes, and min-hashes in each: sets of similarity 0.8 share none once in 300,000 times.
BANDS, BAND_ROWS = 32, 5
#: Bits (of 128, one of each of as many min-hashes) at which sets are verified: at similarity 0.8 some 13 differ, with a deviation of 3.4.
SEARCH_BITS = 34
#: Bits (of 1,920, twelve of each of 160 min-hashes) at which a member and the first centre are verified: at similarity 0.8 some 192 differ, with a deviation of 32. Blocks do without.
SEARCH_WIDE = 288
#: Bits that are kept of each min-hash, five to an integer.
LANE = 12
#: Members of a bucket that a task compares all with all; the growth of the number of centres of a larger one.
FEW, STEP = 8, 16
#: Members of a block of a crowded bucket, or fewer if they have so many shingles; shingles whose bits are compared at once, a multiple of 64.
BLOCK, SHINGLES, WIDTH = 256, 1 << 20, 1 << 15


def _majority(text: bytes, words: int, digest, size: int) -> bytes:
    """Bits set in over half the digests (of ``size`` bytes) of a text's word shingles, repeats included."""
    tokens = text.lower().split()  # for bytes: A-Z and the six white-space characters only
    if not tokens:
        return bytes(size)
    joined = b" ".join(tokens)
    n = max(1, len(tokens) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[:n]
    stops = ends[min(words, len(tokens)) - 1 :] - 1
    hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), stops.tolist())])
    ones = np.zeros(8 * size, np.int64)
    bits = np.frombuffer(hashes, np.uint8).reshape(n, size)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(bits[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n).tobytes()


def fingerprint(text: bytes, words: int = 3) -> int:
    """SimHash of the word shingles of a text, repeats included, as a signed 64-bit integer."""
    return int.from_bytes(_majority(text, words, xxhash.xxh64_digest, 8), "big", signed=True)


def shingle_set(text: bytes, words: int = SIMILAR_WORDS) -> np.ndarray:
    """Hashes of the distinct word shingles of a text."""
    tokens = text.lower().split()
    found = {b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))}
    return np.unique(np.array([xxhash.xxh3_64_intdigest(s) for s in found], np.uint64)).view(np.int64)


def set_name(shingles: np.ndarray) -> tuple[int, int]:
    """Hash of a shingle set, as two signed integers."""
    name = xxhash.xxh3_128_digest(shingles.tobytes())
    return int.from_bytes(name[:8], "big", signed=True), int.from_bytes(name[8:], "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp) of each row, whole texts."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([fingerprint(t.as_py(), words) for t in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fps], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), text_of(docs, text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, f"id {kind.simpleString()}, fp long")


def _fuzzy_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, fp) of all buckets of each fingerprint."""
    word = fp.view(np.uint64)
    part = [((word >> np.uint64(at)) & np.uint64((1 << size) - 1)).astype(np.int64) for at, size in SEGMENTS]
    keys, whose = [], []
    for i in range(3):
        j = (i + 1) % 3
        rows, index = near_indices(part[j], SEGMENTS[j][1])
        keys.append(np.int64(i) << 60 | part[i][rows] << 12 | index)
        whose.append(fp[rows])
    return np.concatenate(keys), np.concatenate(whose)


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            k, f = _fuzzy_keys(b.column(0).to_numpy().copy())
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(f)], ["key", "fp"])


def _local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node reached from each of n nodes over the edges a-b."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(before, label):
            return label


def _spanning_links(fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, smallest member it reaches) within a bucket of distinct fingerprints.

    A large bucket is settled by shared one-bit variants, dealt into parts by a hash
    of the variant, so beside the bucket itself some ``VARIANTS`` of them are held.
    """
    word = fp.view(np.uint64)
    if len(fp) <= MATRIX:
        a, b = np.nonzero(np.triu(np.bitwise_count(word[:, None] ^ word[None, :]) <= max_bits, 1))
        label = _local_components(len(fp), a, b)
    else:  # two bits apart is one bit each from a common variant
        flips = [np.uint64(0), *(np.uint64(1) << np.arange(64, dtype=np.uint64))] if max_bits > 1 else [np.uint64(0)]
        parts = -(-len(fp) * len(flips) // VARIANTS)
        label = np.arange(len(fp))
        for part in range(parts):
            held, owner = [], []
            for flip in flips:
                variant = word ^ flip
                mine = np.flatnonzero((variant * _MIX >> np.uint64(32)) % np.uint64(parts) == part)
                held.append(variant[mine])
                owner.append(mine)
            variants, whose = np.concatenate(held), np.concatenate(owner)
            order = np.argsort(variants, kind="stable")
            same = variants[order][1:] == variants[order][:-1]
            a, b = label[whose[order][1:][same]], label[whose[order][:-1][same]]
            label = _local_components(len(fp), a, b)[label]
        if max_bits == 1:  # one bit apart: one is a variant of the other
            at = np.argsort(word)
            for bit in range(64):
                found = np.searchsorted(word[at], word ^ (np.uint64(1) << np.uint64(bit)))
                found[found == len(at)] = 0
                hit = np.flatnonzero(word[at][found] == word ^ (np.uint64(1) << np.uint64(bit)))
                label = _local_components(len(fp), label[hit], label[at[found[hit]]])[label]
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return fp[moved], fp[label[moved]]


def _link_buckets(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fp in _buckets_of(batches):
            at, size = _starts(key)
            two = at[size == 2]
            near = np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= max_bits
            a, b = [fp[two[near]]], [fp[two[near] + 1]]
            for s, n in zip(at[size > 2].tolist(), size[size > 2].tolist()):
                x, y = _spanning_links(np.ascontiguousarray(fp[s : s + n]), max_bits)
                a.append(x)
                b.append(y)
            edges = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])

    return run


def golay_links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): links that span the fingerprints of each bucket of equal Golay keys."""
    if not 0 <= max_bits <= 2:
        raise ValueError("the segments are made for at most two differing bits")
    distinct = fps.select("fp").distinct()
    keys = distinct.mapInArrow(_emit_keys, "key long, fp long")
    return keys.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_link_buckets(max_bits), "a long, b long")


def link_fingerprints(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, root): fingerprints that link to others, with a common root for each component."""
    return connected_components(golay_links(fps, max_bits), "op7-edges").select(F.col("node").alias("fp"), F.col("component").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id (smallest id reachable)."""
    fps = cut(fingerprints(docs, id_col, text_col, words), "op7-fingerprints")
    roots = cut(link_fingerprints(fps, max_bits), "op7-roots")
    least = fps.groupBy("fp").agg(F.min("id").alias("id"))
    rooted = least.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "id")
    # Components of fingerprints are few rows each; the smallest id is combined before the shuffle.
    component = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    known = cut(rooted.select("fp", "root").join(component, "root").select("fp", "component_id"), "op7-known")
    return fps.join(known, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---- near copies by shared shingles -----------------------------------------------------------


#: A row of a bucket: its key, a set's name and size, and the bits of its min-hashes.
_BUCKET = ["key", "h1", "h2", "n", "f1", "f2"]

_ROUNDS = 8
_DRAWS = np.random.default_rng(SEED).integers(0, 1 << 64, (2, _ROUNDS + BANDS * BAND_ROWS), np.uint64)
_XOR, _ODD = _DRAWS[0], _DRAWS[1] | np.uint64(1)
_SLOTS = BANDS * BAND_ROWS
_EDGES = np.array([(s << 64) // _SLOTS + (s > 0) for s in range(_SLOTS)], np.uint64)


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """Min-hashes of a sorted shingle set: two sets agree in each with their similarity's probability.

    Every shingle is thrown into one slot by its hash, which is enough to fill the
    slots of a long text; slots still empty are filled by the next throws, and the
    last by min-hashes of their own. A slot's throw depends on the union of two sets
    only, so both agree in it just as in min-hashes of separate functions.
    """
    x = shingles.view(np.uint64)
    at = np.searchsorted(x, _EDGES)
    held = np.append(x, np.uint64(0))[at]
    empty = np.append(at[1:], len(x)) == at
    if empty.any():
        thrown = (x[:, None] ^ _XOR[:_ROUNDS]) * _ODD[:_ROUNDS]
        slot = (thrown >> np.uint64(32)) * np.uint64(_SLOTS) >> np.uint64(32)
        least = np.full((_ROUNDS, _SLOTS), np.iinfo(np.uint64).max)
        np.minimum.at(least, (np.broadcast_to(np.arange(_ROUNDS), slot.shape), slot.astype(np.int64)), thrown)
        for row in least:
            fill = empty & (row != np.iinfo(np.uint64).max)
            held[fill] = row[fill]
            empty &= ~fill
        rest = np.flatnonzero(empty)
        if len(rest):
            held[rest] = ((x[:, None] ^ _XOR[_ROUNDS + rest]) * _ODD[_ROUNDS + rest]).min(axis=0)
    return held


def band_keys(shingles: np.ndarray) -> tuple[np.ndarray, int, int]:
    """The bands of a shingle set's min-hashes, ``LANE`` bits of each, and a bit of each of 128 of them as two signed integers."""
    mixed = min_hashes(shingles) * _MIX
    mixed ^= mixed >> np.uint64(29)
    lanes = (mixed * _MIX >> np.uint64(64 - LANE)).reshape(BANDS, BAND_ROWS)
    bands = (lanes << (np.arange(BAND_ROWS, dtype=np.uint64) * np.uint64(LANE))).sum(axis=1, dtype=np.uint64)
    bits = np.packbits((mixed[:128] >> np.uint64(63)).astype(np.uint8)).view(np.int64)
    return bands.view(np.int64), int(bits[0]), int(bits[1])


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints, the last axis holding their two integers."""
    return np.bitwise_count((x ^ y).view(np.uint64)).sum(axis=-1, dtype=np.int64)


def _near(n: np.ndarray, f: np.ndarray, x, y) -> np.ndarray:
    """Whether sets x and y are to be verified: by their sizes, which is exact, and by their fingerprints."""
    return (np.minimum(n[x], n[y]) >= SIMILARITY * np.maximum(n[x], n[y])) & (_apart(f[x], f[y]) <= SEARCH_BITS)


def _buckets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of rows dealt and sorted by their first column, some ten thousand rows of whole buckets at a time."""
    held, rows = [], 0
    for batch in batches:
        held.append([c.to_numpy() for c in batch.columns])
        rows += batch.num_rows
        if rows >= 50_000:
            cols = [np.concatenate(x) for x in zip(*held)]
            whole = int(np.searchsorted(cols[0], cols[0][-1]))  # the last bucket may go on
            if whole:
                yield [x[:whole] for x in cols]
                held, rows = [[x[whole:] for x in cols]], rows - whole
    if rows:
        yield [np.concatenate(x) for x in zip(*held)]


def _starts(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the buckets of a sorted column start, and their sizes."""
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return at, np.diff(np.concatenate([at, [len(key)]]))


_PAIR = ["a1", "a2", "b1", "b2"]


def _bucket_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs to verify within buckets of at most ``FEW`` sets."""
    for key, h1, h2, n, f1, f2 in _buckets_of(batches):
        h, f = np.stack([h1, h2], axis=1), np.stack([f1, f2], axis=1)
        at, size = _starts(key)
        for gap in range(1, FEW):  # each member and the one ``gap`` places on, of all buckets at once
            x = np.flatnonzero(np.arange(len(key)) + gap < np.repeat(at + size, size))
            x = x[_near(n, f, x, x + gap)]
            if len(x):
                pairs = np.unique(np.concatenate([h[x], h[x + gap]], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, i]) for i in range(4)], _PAIR)


def _differing(a: str, b: str):
    """How many bits of the bands of two sets differ, and the first band in which none does, as columns."""
    apart = [F.col(a)[i].bitwiseXOR(F.col(b)[i]) for i in range(BANDS)]
    first = F.when(apart[0] == 0, 0)
    for i, x in enumerate(apart[1:], 1):
        first = first.when(x == 0, i)
    return reduce(add, map(F.bit_count, apart)), first


def _meetings(rows: DataFrame, low: int, high: int) -> DataFrame:
    """(a1, a2, b1, b2): members of crowded buckets and the centres, of other groups and smaller place, that they meet.

    rows: key, band, h1, h2, n, f1, f2, bands, size, at (a hash of the member), g1, g2.
    A member's place is its hash modulo the bucket's size; centres are the members
    whose place lies in [low, high). Two members meet at the one with the smaller
    place, in the first bucket that both are in.
    """
    columns = ("h1", "h2", "n", "f1", "f2", "bands", "at", "place", "g1", "g2")
    placed = rows.select("key", "band", *columns[:7], F.pmod("at", "size").alias("place"), "g1", "g2")
    centre = placed.where((F.col("place") >= low) & (F.col("place") < high)).select("key", *(F.col(c).alias(f"c_{c}") for c in columns))
    wide, first = _differing("bands", "c_bands")
    later = (F.col("place") > F.col("c_place")) | ((F.col("place") == F.col("c_place")) & (F.col("at") > F.col("c_at")))
    fits = F.least("n", "c_n") >= SIMILARITY * F.greatest("n", "c_n")
    bits = F.bit_count(F.col("f1").bitwiseXOR(F.col("c_f1"))) + F.bit_count(F.col("f2").bitwiseXOR(F.col("c_f2"))) <= SEARCH_BITS
    other = (F.col("g1") != F.col("c_g1")) | (F.col("g2") != F.col("c_g2"))
    met = placed.join(centre, (placed["key"] == centre["key"]) & later & bits & fits & other & (wide <= SEARCH_WIDE) & (first == F.col("band")))
    return met.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("c_h1").alias("b1"), F.col("c_h2").alias("b2")).distinct()


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of equal cell, of batches dealt and sorted by it, a cell at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            cell = batch.column("cell").to_numpy()
            for at, size in zip(*(x.tolist() for x in _starts(cell))):
                if held and held[-1].column("cell")[0].as_py() != cell[at]:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(at, size))
    if held:
        yield pa.Table.from_batches(held)


def _common(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many shingles the sets x and y share, of each pair: bits of the shingles that repeat, some at a time."""
    found, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, repeats = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), times > 1
    place = (np.cumsum(repeats) - 1)[at]
    owner, place = owner[repeats[at]], place[repeats[at]]
    common, shared = np.zeros(len(x), np.int64), int(repeats.sum())
    for low in range(0, shared, WIDTH):
        bits = np.zeros((len(sets), min(WIDTH, -(-(shared - low) // 64) * 64)), bool)
        mine = (place >= low) & (place < low + WIDTH)
        bits[owner[mine], place[mine] - low] = True
        words = np.packbits(bits, axis=1).view(np.uint64)
        for i in range(0, len(x), 4096):
            some = slice(i, i + 4096)
            common[some] += np.bitwise_count(words[x[some]] & words[y[some]]).sum(axis=1, dtype=np.int64)
    return common


def _cell_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within a cell, of members of different groups whose first common band is the cell's: as many as span them."""
    for t in _cells(batches):
        band, block, n, g1, g2 = (t.column(c).to_numpy() for c in ("band", "block", "n", "g1", "g2"))
        h, f = (np.stack([t.column(c).to_numpy() for c in v], axis=1) for v in (("h1", "h2"), ("f1", "f2")))
        lanes = t.column("bands").combine_chunks().flatten().to_numpy().reshape(len(n), BANDS)
        x, y = np.triu_indices(len(n), 1)
        if block.min() != block.max():  # each of two blocks meets itself in a cell of its own
            across = block[x] != block[y]
            x, y = x[across], y[across]
        keep = ((g1[x] != g1[y]) | (g2[x] != g2[y])) & _near(n, f, x, y)
        x, y = x[keep], y[keep]
        keep = (lanes[x] == lanes[y]).argmax(axis=1) == band[x]  # they agree in that one at least
        x, y = x[keep], y[keep]
        if len(x):
            who, at = np.unique(np.concatenate([x, y]), return_inverse=True)
            s = t.column("s")
            common = _common([s[i].values.to_numpy() for i in who.tolist()], at[: len(x)], at[len(x) :])
            similar = common >= SIMILARITY * (n[x].astype(np.int64) + n[y] - common)
            label = _local_components(len(n), x[similar], y[similar])
            moved = np.flatnonzero(label != np.arange(len(n)))
            ends = np.concatenate([h[moved], h[label[moved]]], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, i]) for i in range(4)], _PAIR)


def _crowded_links(rows: DataFrame, shingles: DataFrame) -> DataFrame:
    """(a1, a2, b1, b2): links between members of a bucket that are of different groups, rows as for :func:`_meetings`.

    The members outside of a bucket's largest group are dealt into blocks of some
    ``BLOCK``, and so are those within. A block of the others meets every block, one
    within meets those of the others; two blocks that meet are a cell. A bucket of
    one group has no others, so none of it is dealt.
    """
    counts = rows.groupBy("key", "g1", "g2").agg(F.count(F.lit(1)).alias("own"), F.sum("n").alias("held"))
    most = counts.groupBy("key").agg(F.max(F.struct("own", "held", "g1", "g2")).alias("most"), F.sum("own").alias("size"), F.sum("held").alias("all"))
    others, within = (f"ceil(greatest(({n}) / {BLOCK}, ({s}) / {SHINGLES}))" for n, s in (("size - most.own", "all - most.held"), ("most.own", "most.held")))
    plan = most.where("size > most.own").selectExpr("key", "most.g1 AS m1", "most.g2 AS m2", f"{others} AS others", f"{within} AS within")
    inside = (F.col("g1") == F.col("m1")) & (F.col("g2") == F.col("m2"))
    placed = rows.drop("size").join(plan, "key").join(shingles.select("h1", "h2", "s"), ["h1", "h2"]).withColumn("block", F.when(inside, F.col("others") + F.pmod("at", "within")).otherwise(F.pmod("at", "others")))
    meets = F.sequence(F.lit(0).cast("long"), F.when(inside, F.col("others")).otherwise(F.col("others") + F.col("within")) - 1)
    dealt = placed.withColumn("other", F.explode(meets)).withColumn("cell", F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")))
    columns = ("cell", "band", "block", "h1", "h2", "n", "f1", "f2", "bands", "g1", "g2", "s")
    return dealt.select(*columns).repartition("cell").sortWithinPartitions("cell").mapInArrow(_cell_links, "a1 long, a2 long, b1 long, b2 long")


def _shingle_sets(docs: DataFrame, asked: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(h1, h2, id, s): the shingles of the sets of ``asked`` (h1, h2, id)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [shingle_set(t.as_py()) for t in b.column("t")]
            # An id may have further rows with other texts.
            own = [set_name(s) == x for s, x in zip(held, zip(b.column("h1").to_pylist(), b.column("h2").to_pylist()))]
            held = pa.array([s if ok else None for s, ok in zip(held, own)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("h1"), b.column("h2"), b.column("id"), held], ["h1", "h2", "id", "s"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), text_of(docs, text_col).cast("binary").alias("t")).join(asked, "id").select("h1", "h2", "id", "t")
    found = texts.mapInArrow(run, f"h1 long, h2 long, id {kind}, s array<bigint>").where("s IS NOT NULL")
    return cut(found.dropDuplicates(["h1", "h2"]), "op7-shingles")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): those of the pairs whose sets are similar, as (id, h1, h2)."""
    node = F.struct("id", "h1", "h2")
    right = sets.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), node.alias("b"), F.col("s").alias("sb"))
    left = sets.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), node.alias("a"), F.col("s").alias("sa"))
    # First the side that many pairs may share, while the pairs are thin.
    both = pairs.join(right, ["b1", "b2"]).select("a1", "a2", "b", "sb").join(left, ["a1", "a2"])
    common = F.size(F.array_intersect("sa", "sb"))
    links = both.select("a", "b", common.alias("n"), (F.size("sa") + F.size("sb")).alias("of"))
    return links.where(F.col("n") >= SIMILARITY * (F.col("of") - F.col("n"))).select("a", "b")


def _golay_pairs(sets: DataFrame) -> DataFrame:
    """(a1, a2, b1, b2): pairs to verify that span the sets whose SimHashes link by Golay keys. sets: h1, h2, fp.

    Of the sets of one fingerprint the least meets all others and, for all of them, that
    of a linked fingerprint.
    """
    least = cut(sets.groupBy("fp").agg(F.min(F.struct("h1", "h2")).alias("own")), "op7-least")
    same = sets.join(least, "fp").where((F.col("h1") != F.col("own.h1")) | (F.col("h2") != F.col("own.h2")))
    links = golay_links(least).distinct().join(least.toDF("a", "x"), "a").join(least.toDF("b", "y"), "b")
    return same.selectExpr("h1 AS a1", "h2 AS a2", "own.h1 AS b1", "own.h2 AS b2").unionByName(links.selectExpr("x.h1 AS a1", "x.h2 AS a2", "y.h1 AS b1", "y.h2 AS b2"))


def _grouped(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with the group of each set: g1, g2."""
    known = groups.select("node.h1", "node.h2", F.col("component.h1").alias("g1"), F.col("component.h2").alias("g2"))
    return rows.join(known, ["h1", "h2"], "left").withColumns({"g1": F.coalesce("g1", "h1"), "g2": F.coalesce("g2", "h2")})


def _joined(groups: DataFrame, links: DataFrame) -> DataFrame:
    """``groups`` (node, component) with those that links (a, b) connect made one."""
    if links.isEmpty():
        return groups
    return connected_components(groups.selectExpr("node AS a", "component AS b").unionByName(links), "op7-similar")


def _similar_groups(docs: DataFrame, sets: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, component) of sets that are near copies, as (id, h1, h2). sets: h1, h2, id, n, f1, f2, bands, fp."""
    keys = sets.select(F.posexplode("bands").alias("band", "lanes"), "h1", "h2", "n", "f1", "f2")
    keys = keys.select(F.xxhash64("band", "lanes").alias("key"), "band", "h1", "h2", "n", "f1", "f2")
    # Written first, so that the join can split a key that very many sets share.
    sizes = cut(keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "op7-sizes", "lz4")
    sized = cut(keys.join(sizes, "key"), "op7-sized", "lz4")
    forget(sizes)
    dealt = sized.where(F.col("size") <= FEW).select(*_BUCKET).repartition("key").sortWithinPartitions("key")
    near = dealt.mapInArrow(_bucket_pairs, "a1 long, a2 long, b1 long, b2 long")
    pairs = cut(_golay_pairs(sets).unionByName(near), "op7-pairs")
    crowded = sized.where(F.col("size") > FEW)
    members = crowded.select("h1", "h2")
    asked = pairs.selectExpr("a1 AS h1", "a2 AS h2").unionByName(pairs.selectExpr("b1 AS h1", "b2 AS h2")).unionByName(members).distinct()
    asked = cut(sets.select("h1", "h2", "id").join(asked, ["h1", "h2"]), "op7-asked")
    shingles = _shingle_sets(docs, asked, id_col, text_col)
    groups = connected_components(_verified(pairs.distinct(), shingles), "op7-similar")
    if crowded.isEmpty():
        return groups
    rows = crowded.join(sets.select("h1", "h2", "bands"), ["h1", "h2"]).withColumn("at", F.xxhash64("h1", "h2", "key"))
    # First a member of each bucket, in place 0, meets all others: where copies are many, this leaves few groups.
    rows = cut(_grouped(rows, groups), "op7-crowded", "lz4")
    met = cut(_meetings(rows, 0, 1), "op7-met", "lz4")
    groups = _joined(groups, cut(_verified(met, shingles), "op7-links"))
    before, rows = rows, cut(_grouped(rows.drop("g1", "g2"), groups), "op7-crowded", "lz4")
    forget(before, met)
    free_shuffles(docs.sparkSession)
    named = shingles.select("h1", "h2", F.struct("id", "h1", "h2").alias("node"))
    links = cut(_crowded_links(rows, shingles), "op7-cells")
    links = links.join(named.toDF("a1", "a2", "a"), ["a1", "a2"]).join(named.toDF("b1", "b2", "b"), ["b1", "b2"]).select("a", "b")
    return _joined(groups, links)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their group of near copies."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() for t in b.column(1)]
            shingles = [shingle_set(t) for t in texts]
            names, bands = [set_name(s) for s in shingles], [band_keys(s) for s in shingles]
            halves = [pa.array([x[i] for x in v], pa.int64()) for v, i in ((names, 0), (names, 1), (bands, 1), (bands, 2))]
            sizes, lanes = pa.array([len(s) for s in shingles], pa.int32()), pa.array([x[0] for x in bands], pa.list_(pa.int64()))
            fps = pa.array([fingerprint(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *halves[:2], sizes, *halves[2:], lanes, fps], ["id", "h1", "h2", "n", "f1", "f2", "bands", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), text_of(docs, text_col).cast("binary").alias("t"))
    held = cut(rows.mapInArrow(run, f"id {kind}, h1 long, h2 long, n int, f1 long, f2 long, bands array<bigint>, fp long"), "op7-wide")
    with scratch(docs.sparkSession):
        first = [*(F.first(x).alias(x) for x in ("n", "f1", "f2", "bands")), F.min("fp").alias("fp")]
        sets = cut(held.where("id IS NOT NULL").groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("rows"), *first), "op7-sets")
        groups = _similar_groups(docs, sets, id_col, text_col).select("node.h1", "node.h2", F.col("component.id").alias("root"))
        rooted = sets.join(groups, ["h1", "h2"], "left").select("h1", "h2", "id", "rows", F.coalesce("root", "id").alias("keep"))
        rooted = cut(rooted.where("rows > 1 OR id <> keep").select("h1", "h2", "keep"), "op7-rooted", keep=True)
    drop = held.select("id", "h1", "h2").join(rooted, ["h1", "h2"]).where("id <> keep").select(F.col("id").alias("_drop")).distinct()
    return docs.join(drop, docs[id_col] == drop["_drop"], "left_anti")
