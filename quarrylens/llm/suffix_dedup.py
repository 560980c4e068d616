"""Removal of repeated byte strings by a hash-compared suffix sort.

Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere
else is removed. Sorting every text end of a corpus would not scale, so the sort
is sparse: each window of ``LENGTH`` bytes picks its *anchor*, the gram of
``GRAM`` bytes with the least hash. Equal windows pick equal anchors at equal
offsets, so windows can only repeat where anchors do, and anchors that occur
once are gone after one count.

An anchor's *context* is all that its windows can cover. Anchors whose contexts
all agree repeat whole. Where contexts of an anchor differ, the text after the
anchor and the reversed text before it are sorted by the merge sort of
``suffix_sort``; common lengths with neighbours cut both orders into blocks for
each offset, and a window repeats where two contexts share a block in both.
Found windows are verified byte by byte.

An anchor with over ``HOT`` distinct contexts (a line that very many texts
share) would put them all in one task. Its windows are instead grouped by their
own bytes and counted, combined before the shuffle: the exact way for the rest.

Texts are identified by 96 bits of two hashes; contexts are taken as copies of one
another by 128 bits, the hash of the anchor and that of the context. All other
windows are compared byte by byte. Equal texts are handled once.

Defined results: a null text counts as empty; texts shorter than ``LENGTH``
lose nothing; a text that occurs more than once loses all its bytes if it is
long enough, in every copy; rows with null or repeated ids keep their rows;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget, scratch, small_batches, text_of
from .suffix_sort import BASE, Ends, padded

LENGTH, GRAM = 200, 40
#: The most bytes before an anchor, and from its start on, that its windows cover.
BEFORE, AFTER = LENGTH - GRAM, LENGTH
#: Distinct contexts of an anchor that one task compares, some 12 MB.
HOT = 32_768
#: Bytes hashed at a time (small enough for the processor's cache), and text rows sorted at a time.
CHUNK, SLAB = 1 << 17, 4096

_MIX = np.uint64(0xBF58476D1CE4E5B9)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64."""
    up, down = np.full(n, BASE), np.full(n, np.uint64(pow(int(BASE), -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _powers_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(max(CHUNK * 2, 1 << (n - 1).bit_length()))
    return up[:n], down[:n]


def _gram_hashes(x: np.ndarray) -> np.ndarray:
    """Hash of the gram that starts at each byte."""
    up, down = _powers_of(len(x))
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * down, out=sums[1:])
    m = len(x) - GRAM + 1
    return (sums[GRAM:] - sums[:-GRAM]) * up[:m]


def _window_anchors(gram: np.ndarray) -> np.ndarray:
    """Place of the least gram of each window, the first of equals."""
    order = gram ^ (gram >> np.uint64(29))
    order *= _MIX
    order ^= order >> np.uint64(32)
    least = (order << np.uint64(32)) | np.arange(len(gram), dtype=np.uint64)
    reach, width = LENGTH - GRAM + 1, 1
    while 2 * width <= reach:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if reach > width:
        least = np.minimum(least[: width - reach], least[reach - width :])
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _context_hash(text: bytes, start: int, stop: int, before: int) -> int:
    return xxhash.xxh3_64_intdigest(text[start:stop], before)


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, place, gram hash, context hash) of the anchors of some texts."""
    out: list[tuple] = []

    def solve(first: int, group: list[bytes]) -> None:
        buf = b"".join(group)
        if len(buf) < LENGTH:
            return
        x = np.frombuffer(buf, np.uint8)
        sizes = np.fromiter(map(len, group), np.int64, len(group))
        ends = np.cumsum(sizes)
        gram = _gram_hashes(x)
        at = _window_anchors(gram)
        inside = np.arange(len(at)) + LENGTH <= np.repeat(ends, sizes)[: len(at)]
        found = at[inside]
        found = found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) else found  # places rise
        which = np.searchsorted(ends, found, side="right")
        place = found - (ends - sizes)[which]
        before, stop = np.minimum(BEFORE, place), np.minimum(found + AFTER, ends[which])
        ctx = [_context_hash(buf, p - b, e, b) for p, b, e in zip(found.tolist(), before.tolist(), stop.tolist())]
        out.append((which + first, place, gram[found].view(np.int64), np.array(ctx, np.uint64).view(np.int64)))

    at = 0
    while at < len(texts):
        if len(texts[at]) > 8 * CHUNK:  # a very long text in overlapping pieces, each window in one
            out += [_long(texts[at], at)]
            at += 1
            continue
        stop, total = at, 0
        while stop < len(texts) and total < CHUNK and len(texts[stop]) <= 8 * CHUNK:
            total += len(texts[stop])
            stop += 1
        solve(at, texts[at:stop])
        at = stop
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(c) for c in zip(*out))


def _long(text: bytes, number: int) -> tuple:
    x, places, grams = np.frombuffer(text, np.uint8), [], []
    for start in range(0, len(x) - LENGTH + 1, CHUNK):
        piece = x[start : start + CHUNK + LENGTH - 1]
        gram = _gram_hashes(piece)
        at = np.unique(_window_anchors(gram))
        places.append(at + start)
        grams.append(gram[at])
    place, first = np.unique(np.concatenate(places), return_index=True)
    gram = np.concatenate(grams)[first]
    before = np.minimum(BEFORE, place)
    ctx = [_context_hash(text, p - b, min(p + AFTER, len(text)), b) for p, b in zip(place.tolist(), before.tolist())]
    return np.full(len(place), number), place, gram.view(np.int64), np.array(ctx, np.uint64).view(np.int64)


def _own_windows(context: bytes, before: int) -> range | np.ndarray:
    """Offsets before the anchor of the windows of a context that pick it."""
    at = _window_anchors(_gram_hashes(np.frombuffer(context, np.uint8)))
    return before - np.flatnonzero(at == before)


# ---- Spark stages -----------------------------------------------------------------------------


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1).compress
    for b in batches:
        z = pa.array([pack(t.as_py()) for t in b.column(2)], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), z], ["t1", "t2", "z"])


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        which, place, g, c = anchors([t.as_py() for t in b.column(2)])
        t1, t2 = b.column(0).to_numpy()[which], b.column(1).to_numpy()[which]
        for i in range(0, max(1, len(g)), 50_000):
            s = slice(i, i + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(v[s]) for v in (g, c, t1, t2)] + [pa.array(place[s].astype(np.int32))], ["g", "c", "t1", "t2", "pos"])


def _fetch_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of listed anchors (d: -1); of hot ones their windows. (g, c, n, d, before, data)"""
    unpack = zstandard.ZstdDecompressor().decompress
    names = ["g", "c", "n", "d", "before", "data"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(col, k) for col, k in zip(zip(*rows), kinds)], names)

    rows: list[tuple] = []
    for b in batches:
        for z, wanted in zip(b.column("z"), b.column("wanted")):
            text = unpack(z.as_py())
            for a in wanted.as_py():
                p, n = a["pos"], min(a["n"], 2)
                before = min(BEFORE, p)
                data = text[p - before : p + AFTER]
                if not a["hot"]:
                    rows.append((a["g"], a["c"], n, -1, before, data))
                else:
                    for d in _own_windows(data, before).tolist():
                        rows.append((a["g"], a["c"], n, d, before, data[before - d : before - d + LENGTH]))
            if len(rows) >= 5000:
                yield emit(rows)
                rows = []
    if rows:
        yield emit(rows)


def _repeated_extents(group: np.ndarray, weight: np.ndarray, before: np.ndarray, data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes before and after each context's anchor that repeated windows cover (-1: none).

    group: numbers of consecutive anchors; weight: how often a context occurs.
    """
    m = len(group)
    new = np.concatenate([[True], group[1:] != group[:-1]])
    starts = np.flatnonzero(new)
    sizes = np.diff(np.concatenate([starts, [m]]))
    start, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
    cuts = before.tolist()
    right = Ends(*padded([t[b:] for t, b in zip(data, cuts)], AFTER))
    left = Ends(*padded([t[:b][::-1] for t, b in zip(data, cuts)], BEFORE))
    orders = [side.sort(start, size) for side in (left, right)]
    shared = [side.neighbours(o, group) for side, o in zip((left, right), orders)]
    most = []
    for o, s in zip(orders, shared):
        near = np.full(m, -1, np.int64)
        near[o] = np.maximum(s, np.concatenate([s[1:], [-1]]))
        most.append(near)
    far, near = np.full(m, -1, np.int64), np.full(m, -1, np.int64)  # largest and smallest repeated offset
    far_of, near_of = np.zeros(m, np.int64), np.zeros(m, np.int64)
    asked = (weight < 2) & (most[0] + most[1] >= LENGTH)
    if asked.any():
        whole = np.isin(group, np.unique(group[asked]))  # other anchors are settled
        ranks = []
        for o in orders:
            r = np.empty(m, np.int64)
            r[o] = np.arange(m)
            ranks.append(r)
        rows = np.flatnonzero(whole)
        for d in range(BEFORE + 1):
            blocks = [np.cumsum(s < least) for s, least in zip(shared, (d, LENGTH - d))]
            key = blocks[0][ranks[0][rows]] * np.int64(m + 1) + blocks[1][ranks[1][rows]]
            long_enough = (before[rows] >= d) & (right.length[rows] >= LENGTH - d)
            r, k = rows[long_enough], key[long_enough]
            o = np.argsort(k, kind="stable")
            r, k = r[o], k[o]
            pair = np.flatnonzero(k[1:] == k[:-1])
            if not len(pair):
                continue
            partner = np.full(m, -1, np.int64)
            partner[r[pair]] = r[pair + 1]
            partner[r[pair + 1]] = r[pair]
            hit = partner >= 0
            far[hit], far_of[hit] = d, partner[hit]
            fresh = hit & (near < 0)
            near[fresh], near_of[fresh] = d, partner[fresh]
    for i in np.flatnonzero((far >= 0) & (weight < 2)).tolist():  # hashes agreed: now the bytes
        for d, j in ((far[i], far_of[i]), (near[i], near_of[i])):
            a, b = cuts[i] - d, cuts[j] - d
            if data[i][a : a + LENGTH] != data[j][b : b + LENGTH]:
                others = [data[x] for x in range(start[i], start[i] + size[i]) if x != i]
                offsets = [d for d in range(BEFORE + 1) if d <= cuts[i] and len(data[i]) - cuts[i] + d >= LENGTH and any(data[i][cuts[i] - d : cuts[i] - d + LENGTH] in t for t in others)]
                far[i], near[i] = (max(offsets), min(offsets)) if offsets else (-1, -1)
                break
    before_out = np.where(weight >= 2, BEFORE, far)
    after_out = np.where(weight >= 2, AFTER, np.where(near >= 0, LENGTH - near, -1))
    return before_out, after_out


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, c, b, a) of contexts dealt by anchor: the repeated bytes before and after it."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        g, c = t.column("g").to_numpy(), t.column("c").to_numpy()
        b, a = _repeated_extents(g, t.column("n").to_numpy(), t.column("before").to_numpy().astype(np.int64), t.column("data").to_pylist())
        ok = b >= 0
        return pa.RecordBatch.from_arrays([pa.array(g[ok]), pa.array(c[ok]), pa.array(b[ok].astype(np.int32)), pa.array(a[ok].astype(np.int32))], ["g", "c", "b", "a"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) < SLAB:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        g = t.column("g").to_numpy()
        whole = int(np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))[-1])  # the last anchor may go on
        if whole:
            yield solve(t.slice(0, whole))
        held = t.slice(whole).to_batches()
    if sum(x.num_rows for x in held):
        yield solve(pa.Table.from_batches(held).combine_chunks())


def covered(size: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans, clipped to a text of ``size`` bytes."""
    out: list[list[int]] = []
    for start, stop in sorted((max(0, s), min(size, e)) for s, e in spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        elif start < stop:
            out.append([start, stop])
    return [(s, e) for s, e in out]


def _spans_of(text: bytes, copies: int, found: list[dict] | None) -> list[tuple[int, int]]:
    if copies > 1 and len(text) >= LENGTH:
        return [(0, len(text))]
    return covered(len(text), [(x["pos"] - x["b"], x["pos"] + x["a"]) for x in found or ()])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for b in batches:
        rows = []
        for z, copies, found in zip(b.column("z"), b.column("copies"), b.column("found")):
            text = unpack(z.as_py())
            runs = _spans_of(text, copies.as_py(), found.as_py())
            kept = _without(text, runs)
            rows.append((len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
        cols = list(zip(*rows)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [b.column("t1"), b.column("t2"), *(pa.array(v, pa.int64()) for v in cols[:3]), pa.array(cols[3], pa.string())],
            ["t1", "t2", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def _without(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for run in runs for x in run), len(text)]
    return b"".join(text[s:e] for s, e in zip(edges[::2], edges[1::2]))


def _kept_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for b in batches:
        kept = []
        for z, copies, found in zip(b.column("z"), b.column("copies"), b.column("found")):
            text = unpack(z.as_py())
            # A cut inside a character leaves bytes that are no text: those are dropped.
            kept.append(_without(text, _spans_of(text, copies.as_py(), found.as_py())).decode("utf-8", "ignore"))
        yield pa.RecordBatch.from_arrays([b.column("t1"), b.column("t2"), pa.array(kept, pa.string())], ["t1", "t2", "kept"])


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.xxhash64(text_of(docs, text_col)).alias("t1"), F.crc32(text_of(docs, text_col).cast("binary")).alias("t2"), text_of(docs, text_col).cast("binary").alias("t"))


def _distinct_texts(docs: DataFrame, text_col: str) -> DataFrame:
    """(t1, t2, z, copies): each distinct text once, compressed before the shuffle."""
    packed = _keyed(docs, text_col).mapInArrow(_packed, "t1 long, t2 long, z binary")
    return packed.groupBy("t1", "t2").agg(F.first("z").alias("z"), F.count(F.lit(1)).alias("copies"))


def _settled(texts: DataFrame, found: DataFrame) -> DataFrame:
    """Repeated extents (t1, t2, found) of the anchors of each text."""
    # Written first, small tables leave both sides of a join free to be split where a key is hot.
    extent = found.groupBy("g").agg(F.count(F.lit(1)).alias("times"), F.min("c").alias("c1"), F.max("c").alias("c2")).where("times > 1")
    many = cut(extent.select("g", (F.col("c1") != F.col("c2")).alias("mixed")), "op9-many", "lz4")
    marked = cut(found.join(many, "g"), "op9-repeated", "lz4")
    forget(found, many)
    contexts = marked.where("mixed").groupBy("g", "c").agg(F.count(F.lit(1)).alias("n"), *(F.first(x).alias(x) for x in ("t1", "t2", "pos")))
    contexts = cut(contexts, "op9-contexts", "lz4")
    hot = contexts.groupBy("g").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > HOT).select("g", F.lit(True).alias("hot"))
    listed = contexts.join(hot, "g", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))

    def fetched(rows: DataFrame) -> DataFrame:
        # At most the anchors of one text; the exchange of the texts is one for all uses in the plan.
        wanted = rows.groupBy("t1", "t2").agg(F.collect_list(F.struct("pos", "g", "c", "n", "hot")).alias("wanted"))
        return texts.join(wanted, ["t1", "t2"]).mapInArrow(_fetch_contexts, "g long, c long, n long, d int, before int, data binary")

    whole = fetched(listed.where("NOT hot")).repartition("g").sortWithinPartitions("g", "c").mapInArrow(_settle, "g long, c long, b int, a int")
    windows = fetched(listed.where("hot")).select("g", "c", "d", "n", "data")
    again = windows.groupBy("g", "data").agg(F.sum("n").alias("times")).where("times > 1").select("g", "data")
    counted = windows.join(again, ["g", "data"]).groupBy("g", "c").agg(F.max("d").alias("b"), (F.lit(LENGTH) - F.min("d")).cast("int").alias("a"))
    places = marked.where("mixed").join(whole.unionByName(counted), ["g", "c"]).select("t1", "t2", "pos", "b", "a")
    same = marked.where("NOT mixed").select("t1", "t2", "pos", F.lit(BEFORE).alias("b"), F.lit(AFTER).alias("a"))
    # Copies of a text have the same places: one of each goes on.
    once = places.unionByName(same).groupBy("t1", "t2", "pos").agg(F.max("b").alias("b"), F.max("a").alias("a"))
    return cut(once.groupBy("t1", "t2").agg(F.collect_list(F.struct("pos", "b", "a")).alias("found")), "op9-spans", keep=True)


def _repeats(docs: DataFrame, text_col: str) -> DataFrame:
    """(t1, t2, z, copies, found) of the distinct texts."""
    small_batches(docs.sparkSession)
    texts = _distinct_texts(docs, text_col)
    with scratch(docs.sparkSession):
        found = cut(_keyed(docs, text_col).mapInArrow(_find_anchors, "g long, c long, t1 long, t2 long, pos int"), "op9-anchors", "lz4")
        spans = _settled(texts, found)
    return texts.join(spans, ["t1", "t2"], "left")


def repeated_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    schema = "t1 long, t2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    results = cut(_repeats(docs, text_col).select("t1", "t2", "z", "copies", "found").mapInArrow(_digests, schema), "op9-results")
    ids = docs.select(F.col(id_col), F.xxhash64(text_of(docs, text_col)).alias("t1"), F.crc32(text_of(docs, text_col).cast("binary")).alias("t2"))
    return ids.join(results, ["t1", "t2"]).select(id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256")


def without_repeats(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` with repeated strings cut out of the text; all rows and columns stay.

    Bytes of characters that a cut splits are dropped. ``length_col``, if given,
    is set to the characters of the new text.
    """
    kept = _repeats(docs, text_col).select("t1", "t2", "z", "copies", "found").mapInArrow(_kept_texts, "t1 long, t2 long, kept string")
    # The columns of docs travel as one struct, so that none can clash with a name used here.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64(text_of(docs, text_col)).alias("t1"), F.crc32(text_of(docs, text_col).cast("binary")).alias("t2"))
    rows = rows.withColumn("row", F.col("row").dropFields(text_col)) if len(docs.columns) > 1 else rows
    joined = rows.join(kept, ["t1", "t2"])
    new = {text_col: F.col("kept")} | ({length_col: F.length("kept").cast(docs.schema[length_col].dataType)} if length_col else {})
    return joined.select(*(new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns))
