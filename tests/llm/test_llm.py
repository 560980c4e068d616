import base64
import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from quarrylens.llm import block_naming, byte_bpe, golay, graph, kdtree_search, length_packing, maxent_lm, page_diff, queries, simhash, suffix_dedup, suffix_sort, toxicity, warc_zip

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
ODD = [None, "", " ", "\t\n", "a", "A b", "x" * 5000, "é😀 ü", "word " * 300]


def _rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


# ---- 10 exact dedup ---------------------------------------------------------------------------


def _exact_rows():
    r = random.Random(3)
    base = ["".join(r.choice("ab \n") for _ in range(r.choice([3, 40, 1500]))) for _ in range(12)]
    rows = [(i, r.choice(base).replace(" ", r.choice(["", " ", "  "]))) for i in range(80)] + [(100 + i, t) for i, t in enumerate(ODD)]
    return rows + [(5, rows[5][1]), (5, rows[5][1]), (None, "a"), (None, None), (None, "zz")]


@pytest.mark.parametrize("block", [4, 512])
def test_exact_groups(spark, block):
    rows = _exact_rows()
    got = block_naming.duplicate_groups(spark.createDataFrame(rows, DOCS), block=block)
    assert _rows(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(brute.exact_groups(rows), key=repr)


def test_exact_drop_keeps_columns(spark):
    rows = [(i, t, i * 2, "n") for i, t in _exact_rows()[:30] if i is not None]
    df = spark.createDataFrame(rows, "doc_id long, text string, _len int, name string")
    kept = block_naming.drop_duplicates(df)
    expected = {d for d, _, _, k, _ in brute.exact_groups([r[:2] for r in rows]) if k}
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == expected and kept.count() == len(expected)


def test_exact_empty(spark):
    assert block_naming.duplicate_groups(spark.createDataFrame([], DOCS)).count() == 0


# ---- 7 near duplicates ------------------------------------------------------------------------


@pytest.mark.parametrize("shape", ["chain", "star", "random", "loops", "empty"])
def test_connected_components(spark, shape):
    rng = random.Random(3)
    edges = {
        "chain": [(i + 1, i) if i % 3 else (i, i + 1) for i in range(60)],
        "star": [(50, i) for i in range(100)] + [(i, 50) for i in range(0, 100, 2)],
        "random": [(rng.randrange(400), rng.randrange(400)) for _ in range(220)],
        "loops": [(5, 5), (7, 8), (8, 7), (7, 8)],
        "empty": [],
    }[shape]
    root = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in range(len(root)):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = graph.connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert sorted(map(tuple, got.collect())) == sorted(root.items())



def test_golay_corrects_three_errors():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 3000)
    index = golay.decode(words)
    rows, near = golay.near_indices(words, 23)
    keys = set(zip(rows.tolist(), near.tolist()))
    assert all((i, k) in keys for i, k in enumerate(index.tolist()))
    for bit in range(23):  # words one bit apart share a key
        assert all((i, k) in keys for i, k in enumerate(golay.decode(words ^ (1 << bit)).tolist()))


@pytest.mark.parametrize("text", ["", "one", "One two", "a b c d", "A\tB\x0bC d\x1ce é", "the cat " * 50])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) & (1 << 64) - 1 == brute.fingerprint(text)


@pytest.mark.parametrize("matrix", [2, 512])
def test_links_are_exact(spark, monkeypatch, matrix):
    r = random.Random(5)
    fps = [r.getrandbits(64) for _ in range(15)]
    for _ in range(250):
        fps.append(r.choice(fps) ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 3))))
    a, b = simhash._spanning_links(np.unique(np.array(fps, np.uint64)).view(np.int64), 2)
    assert len(a) == len(b)
    monkeypatch.setattr(simhash, "MATRIX", matrix)
    x, y = simhash._spanning_links(np.unique(np.array(fps, np.uint64)).view(np.int64), 2)
    assert sorted(zip(a.tolist(), b.tolist())) == sorted(zip(x.tolist(), y.tolist()))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(i, f) for i, f in enumerate(signed)], "id long, fp long")
    roots = {q["fp"]: q["root"] for q in simhash.link_fingerprints(frame).collect()}
    expected = brute.components(list(range(len(fps))), fps)
    mine: dict = {}
    for i, f in enumerate(signed):
        mine.setdefault(roots.get(f, f), []).append(i)
    assert sorted(map(tuple, mine.values())) == sorted(tuple(i for i, e in enumerate(expected) if e == c) for c in set(expected))


def test_near_duplicates(spark):
    r = random.Random(9)
    base = " ".join(r.choice(["oak", "elm", "fir", "ash", "yew", "box"]) + str(r.randint(0, 99)) for _ in range(600))
    rows = [(i, t) for i, t in enumerate(ODD)] + [(50 + i, base.replace("oak7", "", i)) for i in range(6)] + [(50, base)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS))
    fps = [brute.fingerprint(t or "") for _, t in rows]
    expected = [(i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, brute.components([i for i, _ in rows], fps))]
    assert _rows(got, "doc_id", "fingerprint", "component_id") == sorted(expected, key=repr)
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def _similar_rows():
    r = random.Random(12)
    rows = [(i, t) for i, t in enumerate(ODD)]
    for g in range(12):
        base = [r.choice(["oak", "elm", "fir", "ash"]) + str(r.randint(0, 400)) for _ in range(r.randint(120, 500))]
        for v in range(6):
            text = list(base)
            for _ in range(v * len(base) // 250 if g else 3 * v):
                text[r.randrange(len(text))] = f"new{r.randint(0, 9999)}"
            rows.append((100 + 10 * g + v, " ".join(text)))
    return rows


@pytest.mark.parametrize("few", [8, 1])
def test_keep_one_of_near_copies(spark, monkeypatch, few):
    monkeypatch.setattr(simhash, "FEW", few)
    rows = _similar_rows()
    kept = simhash.keep_one(spark.createDataFrame([(*x, "n", 1) for x in rows], DOCS + ", id string, f1 int"))
    assert kept.columns == ["doc_id", "text", "id", "f1"]
    got = {x["doc_id"] for x in kept.collect()}
    expected = brute.similar_components(rows, 5, 0.8)
    groups: dict = {}
    for (i, _), c in zip(rows, expected):
        groups.setdefault(c, set()).add(i)
    assert got == set(groups)


def test_keep_one_with_odd_ids(spark):
    long = " ".join(f"w{i}" for i in range(300))
    rows = [(1, long), (1, long), (2, long + " end"), (None, long), (None, "a lone text"), (None, None), (5, "other")]
    got = _rows(simhash.keep_one(spark.createDataFrame(rows, DOCS)), "doc_id", "text")
    assert got == sorted([(1, long), (1, long), (None, long), (None, "a lone text"), (None, None), (5, "other")], key=repr)
    assert simhash.keep_one(spark.createDataFrame([], DOCS)).count() == 0


def test_keep_one_looks_into_equal_fingerprints(spark):
    line = " ".join(f"line{i}" for i in range(7))
    rows = [(i, " ".join([line] * 60 + [f"u{i}x{k}" for k in range(100)])) for i in range(6)]
    rows.append((9, rows[0][1]))
    assert len({simhash._majority(t.encode(), 3, xxhash.xxh3_128_digest, 16) for _, t in rows}) == 1
    got = {x["doc_id"] for x in simhash.keep_one(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == set(range(6))  # 9 is a copy of 0; the others share one line


@pytest.mark.parametrize("similar", [False, True])
def test_members_of_crowded_buckets_meet(spark, similar):
    """Any two members of a bucket meet once, or are of one group by then."""
    n, met, low, high = 30, [], 0, 1
    while low < n:
        group = 0 if similar and met else None
        rows = [(k, k, i, i, 100, 0, 0, [0] * simhash.BANDS, n, 7 * i + k, i if group is None else 0, i if group is None else 0) for k in range(2) for i in range(n)]
        frame = spark.createDataFrame(rows, "key long, band int, h1 long, h2 long, n int, f1 long, f2 long, bands array<long>, size long, at long, g1 long, g2 long")
        met += [frozenset((x["a1"], x["b1"])) for x in simhash._meetings(frame, low, high).collect()]
        low, high = high, high * simhash.STEP
    assert len(met) == len(set(met)) == (n - 1 if similar else n * (n - 1) // 2)


@pytest.mark.parametrize("block", [256, 7])
def test_crowded_pairs_are_no_rows(spark, monkeypatch, block):
    """A bucket of sets that are nearly, but seldom quite, similar: all are compared, few become rows."""
    r = random.Random(8)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(90):
        text = list(base)
        for at in r.sample(range(300), r.choice([1, 4, 6, 7])):
            text[at] = f"x{i}y{at}"
        rows.append((i, " ".join(text)))
    sizes, verified = [], simhash._verified
    monkeypatch.setattr(simhash, "_verified", lambda pairs, sets: sizes.append(pairs.count()) or verified(pairs, sets))
    monkeypatch.setattr(simhash, "BLOCK", block, raising=False)
    got = {x["doc_id"] for x in simhash.keep_one(spark.createDataFrame(rows, DOCS)).collect()}
    expected = brute.similar_components(rows, 5, 0.8)
    assert got == set(expected) and 10 < len(got) < 80
    assert sum(sizes) < 8 * len(rows)


def test_keep_one_finds_fingerprints_by_golay_keys(spark, monkeypatch):
    """Texts at most two bits apart are found without the bands, those that share a fingerprint only are kept."""
    monkeypatch.setattr(simhash, "_bucket_pairs", lambda batches: iter(()))
    base, line = [f"w{i}" for i in range(900)], [f"line{i}" for i in range(7)]
    rows = [(i, " ".join(base[:450] + [f"x{i}"] * (i > 0) + base[450:])) for i in range(5)]
    rows += [(10 + i, " ".join(line * 60 + [f"u{i}x{k}" for k in range(100)])) for i in range(3)]
    fps = [brute.fingerprint(t) for _, t in rows]
    expected = brute.components([i for i, _ in rows], fps)
    assert expected[0] in expected[1:5] and len(set(expected[5:])) == 1
    got = {x["doc_id"] for x in simhash.keep_one(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == set(expected[:5]) | {10, 11, 12}


@pytest.mark.parametrize("width", [64, 1 << 15])
def test_common_shingles(monkeypatch, width):
    monkeypatch.setattr(simhash, "WIDTH", width)
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 900, n)) for n in (0, 1, 50, 300, 700, 700)]
    x, y = np.triu_indices(len(sets), 1)
    assert simhash._common(sets, x, y).tolist() == [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(x, y)]


def test_differing_bits(spark):
    rng = np.random.default_rng(4)
    rows, expected = [], []
    for _ in range(50):
        a = rng.integers(0, 1 << simhash.LANE, (simhash.BANDS, simhash.BAND_ROWS))
        b = np.where(rng.random(a.shape) < 0.3, rng.integers(0, 1 << simhash.LANE, a.shape), a)
        rows.append([(v << (simhash.LANE * np.arange(simhash.BAND_ROWS))).sum(axis=1).tolist() for v in (a, b)])
        expected.append((int(np.bitwise_count(a ^ b).sum()), next((i for i, x in enumerate((a == b).all(axis=1)) if x), None)))
    frame = spark.createDataFrame(rows, "x array<long>, y array<long>").select(*simhash._differing("x", "y"))
    assert [tuple(r) for r in frame.collect()] == expected


def test_min_hashes_agree_like_the_sets():
    rng = np.random.default_rng(2)
    for n in (1, 5, 40, 300, 3000):
        shared = []
        for _ in range(60):
            x = rng.integers(0, 1 << 64, n + n // 4 * 2, np.uint64)
            a, b = (np.sort(x[: n + n // 4]), np.sort(x[n // 4 :])) if n > 1 else (x, x)
            shared.append((simhash.min_hashes(a) == simhash.min_hashes(b)).mean())
        true = n / (n + n // 4 * 2)
        assert abs(np.mean(shared) - true) < 0.03, (n, np.mean(shared), true)


@pytest.mark.parametrize("max_bits", [0, 1, 2])
def test_large_buckets_in_parts(monkeypatch, max_bits):
    monkeypatch.setattr(simhash, "VARIANTS", 500)
    r = random.Random(max_bits)
    fps = [r.getrandbits(64) for _ in range(40)]
    for _ in range(800):
        fps.append(r.choice(fps) ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 3))))
    fps = np.unique(np.array(fps, np.uint64)).view(np.int64)
    assert len(fps) > simhash.MATRIX
    parts = sorted(zip(*(x.tolist() for x in simhash._spanning_links(fps, max_bits))))
    monkeypatch.setattr(simhash, "MATRIX", 10_000)
    assert parts == sorted(zip(*(x.tolist() for x in simhash._spanning_links(fps, max_bits))))


@pytest.mark.parametrize("kind", ["appended", "block", "scattered"])
def test_search_finds_pairs_at_the_threshold(kind):
    """Single pairs of similarity 0.80 to 0.81 share a bucket and are verified."""
    rng, missed, n = np.random.default_rng(5), 0, 400
    for _ in range(300):
        a = [f"w{x}" for x in rng.integers(0, 1 << 30, n)]
        b = list(a)
        if kind == "appended":
            b += [f"x{x}" for x in rng.integers(0, 1 << 30, n // 4 - 2)]
        elif kind == "block":
            b[100:140] = [f"x{x}" for x in rng.integers(0, 1 << 30, 40)]
        else:
            for at in range(20, 400, 46):
                b[at] = f"x{rng.integers(0, 1 << 30)}"
        sets = [simhash.shingle_set(" ".join(t).encode()) for t in (a, b)]
        same = len(np.intersect1d(*sets))
        assert 0.795 < same / (len(sets[0]) + len(sets[1]) - same) < 0.83
        (k, *f), (m, *g) = (simhash.band_keys(s) for s in sets)
        missed += not set(k.tolist()) & set(m.tolist()) or simhash._apart(np.array(f), np.array(g)) > simhash.SEARCH_BITS
    assert missed == 0


# ---- 9 repeated strings -----------------------------------------------------------------------


def _repeat_rows():
    r = random.Random(5)
    base = ["".join(r.choice("abcde \n") for _ in range(r.randint(150, 900))) for _ in range(12)]
    out = []
    for _ in range(120):
        t = list(r.choice(base))
        for _ in range(r.randint(0, 4)):
            t[r.randrange(len(t))] = r.choice("xyzé")
        out.append("".join(t)[r.randrange(len(t)) // 3 :] + (r.choice(base)[: r.randint(0, 500)] if r.random() < 0.5 else ""))
    return out + ["a" * 3000, "a" * 199, "a" * 200, "ab" * 400, "", None, "x" * 200 + "y" * 150, *ODD]


@pytest.mark.parametrize(("hot", "chunk"), [(32_768, 1 << 17), (3, 1 << 17), (32_768, 64)])
def test_repeats(spark, monkeypatch, hot, chunk):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    texts = _repeat_rows()
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).coalesce(2)
    if chunk < 1000:  # the pieces of long texts, without Spark
        monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
        raw = [(t or "").encode() for t in texts]
        small = suffix_dedup.anchors(raw)
        monkeypatch.setattr(suffix_dedup, "CHUNK", 1 << 17)
        large = suffix_dedup.anchors(raw)
        assert sorted(zip(*(x.tolist() for x in small))) == sorted(zip(*(x.tolist() for x in large)))
        return
    expected = [(i, *x) for i, x in enumerate(brute.repeated_strings([(t or "").encode() for t in texts]))]
    got = suffix_dedup.repeated_strings(docs)
    assert _rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(expected, key=repr)


def test_suffix_sort():
    r = random.Random(2)
    strings = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 12))) for _ in range(300)]
    group = np.sort(np.array([r.randint(0, 9) for _ in strings]))
    start = np.searchsorted(group, group)
    size = np.bincount(group)[group]
    order = suffix_sort.Ends(*suffix_sort.padded(strings, 12)).sort(start, size)
    got = [(group[i], strings[i]) for i in order.tolist()]
    assert got == sorted(got)


def test_without_repeats(spark):
    part = "".join(random.Random(1).choice("abcdefgh ") for _ in range(260))
    df = spark.createDataFrame([(1, "né " + part, 9, 1), (2, part + " end", 9, 2), (3, "own", 9, 3)], "doc_id long, text string, n_chars int, t1 int")
    got = {r["doc_id"]: r for r in suffix_dedup.without_repeats(df, length_col="n_chars").collect()}
    assert (got[1]["text"], got[2]["text"], got[3]["text"]) == ("né ", " end", "own") and got[1]["n_chars"] == 3 and got[2]["t1"] == 2


# ---- 8 byte-level BPE -------------------------------------------------------------------------


def test_bpe(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    codec = byte_bpe.Codec(path, tokenizers.PATTERN)
    other = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=codec.rank, special_tokens={})
    r = random.Random(1)
    texts = [t for t in ODD if t is not None] + ["".join(r.choice("ab é中😀\x1c\x85 \t\n'st123!? ") for _ in range(r.randint(0, 200))) for _ in range(300)]
    texts += ["".join(r.choice("abcdefghi") for _ in range(30_000)), "ab" * 3000, "<|endoftext|>"]
    for t in texts:
        ids = codec.encode(t)
        assert ids == other.encode_ordinary(t) and codec.decode(ids) == t.encode()
    docs = spark.createDataFrame(list(enumerate([*ODD, "the the"])), DOCS)
    encoded = byte_bpe.encode(docs, path, tokenizers.PATTERN)
    back = {x["doc_id"]: bytes(x["bytes"]).decode() for x in byte_bpe.decode(encoded, path, tokenizers.PATTERN).collect()}
    assert back == {i: t or "" for i, t in enumerate([*ODD, "the the"])}
    assert byte_bpe.round_trip_digests(docs, path, tokenizers.PATTERN).count() == len(ODD) + 1


def test_bpe_follows_ranks_that_fall(tmp_path):
    # A merge whose result has a lower rank than its own must go first everywhere.
    ranks = {bytes([b]): 100 + b for b in range(97, 103)} | {b"ab": 50, b"abc": 3, b"bc": 40, b"de": 60, b"cd": 45}
    (tmp_path / "r").write_bytes(b"\n".join(base64.b64encode(k) + b" " + str(v).encode() for k, v in ranks.items()))
    codec = byte_bpe.Codec(str(tmp_path / "r"), r".+")
    tiktoken = pytest.importorskip("tiktoken")
    r = random.Random(4)
    other = tiktoken.Encoding("o", pat_str=r".+", mergeable_ranks=codec.rank, special_tokens={})
    for _ in range(300):
        t = "".join(r.choice("abcdef") for _ in range(r.randint(1, 30)))
        assert codec.encode(t) == other.encode_ordinary(t)


# ---- 6 archives -------------------------------------------------------------------------------


def test_archives(spark):
    long = "<p>" + "x" * 200
    rows = [(1, "http://a/1", long), (2, "http://a/\n2", long), (3, None, "tiny"), (4, "u", "tiny"), (5, "u", None), (5, "u", None), (7, "é", "é" * 60), (None, "n", long), (None, "n", "only" * 50)]
    got = warc_zip.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"))
    found = _rows(got, "page_id", "record_type", "refers_to", "payload_bytes")
    expected = [(1, "response", None, 203), (2, "revisit", 1, 203), (3, "response", None, 4), (4, "response", None, 4), (5, "response", None, 0), (5, "response", None, 0)]
    expected += [(7, "response", None, 120), (None, "revisit", 1, 203), (None, "response", None, 200)]
    assert found == sorted(expected, key=repr)
    assert warc_zip.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_zip64_directory(tmp_path):
    import struct
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for i in range(3):
            with z.open(zipfile.ZipInfo(f"m{i}"), "w", force_zip64=True) as f:
                f.write(b"x" * i)
    data = (tmp_path / "a.zip").read_bytes()
    end = data.rindex(b"PK\5\6")
    n, size, start = struct.unpack("<HII", data[end + 10 : end + 20])
    wide = b"PK\6\6" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, start)
    locator = b"PK\6\7" + struct.pack("<IQI", 0, end, 1)
    full = b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    (tmp_path / "b.zip").write_bytes(data[:end] + wide + locator + full)
    with warc_zip.RangeFile(str(tmp_path / "a.zip")) as a, warc_zip.RangeFile(str(tmp_path / "b.zip")) as b:
        assert warc_zip.directory(a) == warc_zip.directory(b)
        at, length = warc_zip.stored(b, warc_zip.directory(b)["m2"])
        assert b.read(at, length) == b"xx"


# ---- 1 top-k ----------------------------------------------------------------------------------


@pytest.mark.parametrize("shard_rows", [20, 8192])
def test_top_k(spark, shard_rows):
    rng = np.random.default_rng(0)
    v = rng.integers(-9, 9, (150, 6)).tolist()
    v[10:40] = [v[10]] * 30
    rows = [(i, x) for i, x in enumerate(v)] + [(200, None), (201, [1, 2]), (250, [3, 4]), (None, v[0]), (3, v[3])]
    df = spark.createDataFrame(rows, "id long, v array<bigint>")
    got = _rows(kdtree_search.top_k(df, F.col("id") % 50 == 0, 5, shard_rows, 2), "query_id", "rank", "vec_id", "score")
    expected = []
    usable = [(i, x) for i, x in rows if i is not None and x is not None]
    for at, (q, x) in enumerate(usable):
        if q % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for other, (i, y) in enumerate(usable) if other != at and len(y) == len(x))[:5]
        expected += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    assert got == sorted(expected, key=repr)


def test_top_k_beyond_doubles(spark):
    big = 1 << 40
    df = spark.createDataFrame([(0, [big, 1]), (1, [big, 3]), (2, [big, 2]), (3, [-big, 0])], "id long, v array<bigint>")
    got = kdtree_search.top_k(df, F.col("id") == 0, 2).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 2]


def test_top_k_of_repeated_query_ids(spark):
    rows = [(50, [3, 0]), (50, [0, 3]), (1, [5, 0]), (2, [0, 5]), (3, [1, 1])]
    for parts in (1, 4):
        df = spark.createDataFrame(rows, "id long, v array<bigint>").repartition(parts)
        got = _rows(kdtree_search.top_k(df, F.col("id") == 50, 5), "query_id", "rank", "vec_id", "score")
        # Each of the two rows has the other among its candidates.
        assert got == sorted([(50, 1, 1, 15), (50, 2, 3, 3), (50, 3, 2, 0), (50, 4, 50, 0), (50, 1, 2, 15), (50, 2, 3, 3), (50, 3, 1, 0), (50, 4, 50, 0)], key=repr)


def test_integer_vectors(spark):
    df = spark.createDataFrame([(1, [0.5, -0.001]), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, None), (5, [float("inf"), 0.0])], "vec_id long, embedding array<float>")
    assert {r["id"]: r["v"] for r in kdtree_search.integer_vectors(df).collect()} == {1: [128, -1], 2: None, 3: None, 4: None, 5: None}


# ---- 2 pages ----------------------------------------------------------------------------------


def _read_tags(page):
    """Texts between tags, by reading character by character: a quote opens a value after an equals sign only, if it is closed."""
    out, now, i = [], "", 0
    while i < len(page):
        if page[i] == "<" and page[i + 1 : i + 2].isalpha() or page[i : i + 2] == "</" and page[i + 2 : i + 3].isalpha():
            j = i + 1
            while j < len(page) and page[j] != ">":
                k = j + 1
                while page[j] == "=" and k < len(page) and page[k].isspace():
                    k += 1
                closed = page.find(page[k], k + 1) if page[j] == "=" and k < len(page) and page[k] in "\"'" else -1
                j = closed + 1 if closed > 0 else j + 1
            if j >= len(page):
                break
            out, now, i = [*out, now], "", j + 1
        else:
            now, i = now + page[i], i + 1
    return [" ".join(x.split()) for x in [*out, now] if x.strip()]


def test_stray_quotes_end_no_page():
    for page, want in (
        ('<p>See <a href="x"">link</a> now.</p><p>Two.</p><p>Three.</p>', ["See link now.", "Two.", "Three."]), ("<p class=it's>One</p><p>Two</p>", ["One", "Two"]), ('<p title="a>b">One</p><p id="x>Two</p>', ["One", "Two"]),
        ("<p data-x = 'a>b' \">One</p>", ["One"]), ("<p>One</p><p class=", ["One"]),
    ):
        assert [x for x, _ in page_diff.lines_of(page)] == want
    r = random.Random(8)
    for _ in range(3000):
        page = "".join(r.choice(['<p id="', "<p a='", "<p b=", "<p>", '"', "'", ">", "x", "y z", "=", " "]) for _ in range(r.randrange(14)))
        if "<p" in page.rpartition(">")[2]:
            page += ">"
        assert " ".join(x for x, _ in page_diff.lines_of(page)) == " ".join(_read_tags(page)), page


def test_many_equal_lines_are_quick():
    assert len(page_diff.common_lines(["row"] * 40_000, ["row"] * 39_000)) == 39_000


# ---- 4 packing --------------------------------------------------------------------------------


def _padding(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts))


def test_boundaries_are_optimal():
    r = random.Random(6)
    for _ in range(60):
        lengths = sorted(r.sample(range(0, 60), r.randint(1, 8)))
        counts = [r.randint(1, 9) for _ in lengths]
        k = r.randint(1, 5)
        got = length_packing.optimal_boundaries(lengths, counts, k)
        least = min(_padding(lengths, counts, [*c, lengths[-1]]) for n in range(min(k, len(lengths))) for c in combinations(lengths[:-1], n))
        assert len(got) <= k and _padding(lengths, counts, got) == least


def test_pack(spark):
    rows = [(i, "w " * (i % 40)) for i in range(400)] + [(1000, "w " * 900), (1001, None), (None, "w"), (5, "w")]
    got = length_packing.pack(spark.createDataFrame(rows, DOCS), buckets=4, budget=200).collect()
    assert len(got) == len(rows) and all(g["n_tokens"] <= g["padded_length"] for g in got)
    batches: dict = {}
    for g in got:
        batches.setdefault((g["bucket"], g["batch"]), []).append(g)
    for held in batches.values():
        assert sorted(g["place"] for g in held) == list(range(len(held)))
        assert len(held) == 1 or sum(g["padded_length"] for g in held) <= 200
    for b in {g["bucket"] for g in got}:  # all but a bucket's last batch are full
        sizes = [len(v) for (k, _), v in sorted(batches.items()) if k == b]
        assert len(set(sizes[:-1])) <= 1
    assert length_packing.pack(spark.createDataFrame([], DOCS)).count() == 0


# ---- 5 language model -------------------------------------------------------------------------


def _lm_rows():
    r = random.Random(8)
    kinds = [["the", "cat", "sat", "on", "mats", "."], ["le", "chat", "est", "sur", "un", "tapis"]]
    return [(i, " ".join(r.choice(kinds[i % 2]) + ("" if r.random() < 0.95 else str(r.randint(0, 999))) for _ in range(r.randint(0, 60)))) for i in range(300)] + [(400 + i, t) for i, t in enumerate(ODD)]


def test_language_model(spark):
    rows = _lm_rows()
    got = {r["doc_id"]: r for r in maxent_lm.language_model_scores(spark.createDataFrame(rows, DOCS), updates=15).collect()}
    tokens = {i: maxent_lm.tokens((t or "").encode()) + [None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        g = got[i]
        assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert g["base_score"] == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws))
    out = [g for g in got.values() if g["held_out"]]
    assert sum(g["score"] for g in out) > sum(g["base_score"] for g in out)


def test_most_frequent_words(spark):
    r = random.Random(3)
    rows = [(f"w{i}".encode(), r.choice([1, 2, 3, 50, 1000 + i])) for i in range(500)]
    counts = spark.createDataFrame(rows, "w binary, c long")
    for n in (1, 90, 250, 480, 900):
        assert [bytes(x["w"]) for x in maxent_lm._most_frequent(counts, n)] == [w for w, _ in sorted(rows, key=lambda x: (-x[1], x[0]))][:n]


def test_language_model_sums_to_one(spark):
    texts = spark.createDataFrame([(t or "",) for _, t in _lm_rows()], "t string").select(F.col("t").cast("binary").alias("t"))
    model, counts = maxent_lm.train(texts, updates=5)
    known, unknown = model.shares()
    within = np.zeros(maxent_lm.CLASSES)
    for w, c in counts.collect():
        i = model.ready().index.get(bytes(w))
        k = model.word_class[i] if i is not None else model.ending_class[maxent_lm.ending(bytes(w))]
        within[k] += c * 10 ** known[k]
    within += np.where(model.class_tokens > 0, 10**unknown, 1.0)
    assert np.allclose(within, 1) and np.allclose((10.0**model.table).sum(axis=2), 1, atol=1e-4)


def test_language_model_without_rows(spark):
    assert maxent_lm.language_model_scores(spark.createDataFrame([], DOCS), updates=2).count() == 0


# ---- 3 toxicity -------------------------------------------------------------------------------


def test_machine_learns_a_pair():
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for _ in range(600):
        a, b = rng.random(2) < 0.5
        rows.append(np.array([i for i, on in enumerate((a, b)) if on], int))
        labels.append(float(a and b))
    m = toxicity.fit(rows, np.array(labels), np.array([10, 20]))
    z = lambda *t: m.base + sum(m.weight[i] for i in t) + (m.vector[0] @ m.vector[1] if len(t) == 2 else 0)
    assert z(0, 1) > 0 > max(z(0), z(1), z())


def test_toxicity_of_pairs_alone(spark):
    """Terms that say nothing of which text is toxic but by their pairs, which no sum of weights can tell."""
    r = random.Random(4)
    docs, labels = [], []
    for i in range(1200):
        words = [r.choice(["sun", "rain", "road", "tree", "hill", "lake"]) + str(r.randint(0, 40)) for _ in range(30)]
        some, a, b = r.random() < 0.5, r.random() < 0.5, r.random() < 0.5
        words += ["fool" if a else "quack", "gnome" if b else "pilot"] * some
        r.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, int(some and a == b)))
    frame, marks = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")
    held = {i: y for i, y in labels if zlib.crc32(str(i).encode()) % 4 == 2}
    got = {x["doc_id"]: x["predicted"] for x in toxicity.classify(frame, marks).where("held_out").collect()}
    wrong = sum(got[i] != y for i, y in held.items())
    linear = toxicity.train(frame, toxicity.learning_labels(marks), rank=0)
    without = sum((linear.score(docs[i][1]) >= 0.3) != y for i, y in held.items())
    assert wrong <= 0.02 * len(held) and without >= 0.2 * len(held)


def test_toxicity(spark):
    r = random.Random(2)
    docs, labels = [], []
    for i in range(900):
        words = [r.choice(["sun", "rain", "road", "tree", "hill", "lake"]) + str(r.randint(0, 40)) for _ in range(60)]
        toxic = r.random() < 0.2
        if toxic:
            words[r.randint(0, 59)] = r.choice(["nasty", "nastily", "nastiest"])
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs += [(5000 + i, t) for i, t in enumerate(ODD)]
    frame = spark.createDataFrame(docs, DOCS)
    got = {x["doc_id"]: x for x in toxicity.classify(frame, spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")).collect()}
    assert len(got) == len(docs) and all(0 <= x["score"] <= 1 for x in got.values())
    assert all(got[i]["predicted"] == y for i, y in labels)
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    empty = spark.createDataFrame([], DOCS)
    assert toxicity.classify(empty, spark.createDataFrame([], "doc_id long, toxic int")).count() == 0
    none = toxicity.classify(frame, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.where("predicted = 1").count() == 0 and none.count() == len(docs)


# ---- 2 pages ----------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{{}}</style><script>var t="</p><p>no</p>";</script></head><body class="home"><nav><ul><li><a href="/">Menu</a></li></ul></nav>
<!-- <p>hidden</p> --><div class="ad">Buy</div><div class="cookie-notice">We use cookies</div>{body}<div id="comments"><article class="comment"><p>First!</p></article></div><form><p>Search</p></form><footer>&copy; me</footer></body></html>"""


def test_pages(spark):
    body = "<article><header><h1>Big  &lt;news&gt;</h1></header><p><b>One\n two.<br><p>Three<sup>2</sup> &eacute;&#8364;</p><aside>Side</aside><ul><li>a<li>b</ul><div class='share'>Share</div></article>"
    plain = "<div>Site slogan</div><div>{}</div><div>Contact us</div>"
    rows = [
        (1, "http://h/a", PAGE.format(body=body)), (2, "http://h/b", None), (3, None, "<p>x"), (4, "http://s/1", f"<body>{plain.format('First text of this page, long enough to matter here')}"),
        (5, "http://s/2", f"<body>{plain.format('Another text of this page, long enough to matter too')}"), (6, "http://h/c", "<p>a <unended"), (1, "http://h/a", PAGE.format(body=body)),
    ]
    got = page_diff.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert text[1] == "Big <news>\nOne two.\nThree2 é€\na\nb"
    assert (text[2], text[3], text[6]) == ("", "x", "a")
    assert text[4] == "First text of this page, long enough to matter here"
    assert text[5] == "Another text of this page, long enough to matter too"


def test_text_divided_over_articles():
    page = "<body><article><p>First part, the longer one</p></article><article><p>Second part</p></article><article class='{}'><p>Other</p></article></body>"
    lines = page_diff.main_lines(page_diff.lines_of(page.format("teaser")))
    assert lines == [("First part, the longer one", True), ("Second part", False)]
    first, second = ([("Long text of page %d, long enough to matter" % i, True), ("Shared", False)] for i in (1, 2))
    assert page_diff.without_shared(first, second) == ["Long text of page 1, long enough to matter"]


def test_common_lines():
    r = random.Random(7)

    def longest(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for _ in range(100):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 12))] for _ in "ab")
        pairs = page_diff.common_lines(a, b)
        assert len(pairs) == longest(a, b) and all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


# ---- pipeline ---------------------------------------------------------------------------------


def test_pipeline(spark):
    packed = corpus_pipeline.run(spark, SF)
    ids = [r["doc_id"] for r in packed.collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert 0 < len(ids) < docs.count() and len(set(ids)) == len(ids)


def test_stages_return_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("copies", F.lit(1))
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns[-1] == "copies" and "text" in docs.columns


def test_every_operator_is_registered():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
