import hashlib
import random
import re
import zlib

import pytest

from quarrylens.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append(((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()), (role, text)))
    own = {c: [x for _, x in sorted(held)] for c, held in own.items()}
    built = {}
    for c, held in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = (own.get(c - c % 20, [])[:h] if c >= 0 else held[:h]) + held[h:]
    members, ends = {}, {}
    for c, held in built.items():
        for d in range(len(held) + 1):
            members.setdefault(tuple(held[:d]), []).append(c)
        ends.setdefault(tuple(held), []).append(c)
    children, leaves, saved = {}, {}, {}
    for key in members:
        if key:
            children.setdefault(key[:-1], []).append(key)
    for key in sorted(members, key=len, reverse=True):
        below = children.get(key, [])
        leaves[key] = sum(leaves[k] for k in below) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", key[-1][1])) if key else 0
        saved[key] = (len(members[key]) - 1) * words + sum(saved[k] for k in below)
    return sorted(
        ((min(held), len(key), min(members[key[:-1]]) if key else None, len(held), len(children.get(key, [])), leaves[key], saved[key], hashlib.sha256(",".join(map(str, sorted(ends.get(key, [])))).encode()).hexdigest()) for key, held in members.items()),
        key=repr,
    )


def run(spark, rows, block=prefix_trie.BLOCK):
    got = prefix_trie.rebuilt_trie(spark.createDataFrame(rows, SCHEMA).repartition(3), block)
    assert got.columns == COLUMNS and all(t in ("bigint", "string") for _, t in got.dtypes)
    return sorted((tuple(r) for r in got.collect()), key=repr)


def _talks(n=90, seed=2):
    r = random.Random(seed)
    texts = ["hello", "hello there", "a b\tc\x0bd", "é😀 ü", "", "x" * 3000]
    return [(c, t, r.choice(["user", "bot"]), r.choice(texts[: 2 + t])) for c in range(n) for t in range(r.randrange(0, 5))]


@pytest.mark.parametrize("seed", [2, 3])
def test_against_brute_force(spark, seed):
    rows = _talks(seed=seed)
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = _talks(40)
    rows += [(45, None, None, None), (45, 0, None, "t"), (45, 0, "r", None), (45, 0, "r", None), (45, -3, "", ""), (None, 1, "r", "t"), (47, None, "a", "b")]
    rows += [(1001, 0, "r", "t"), (1002, 0, "r", "t"), (1 << 40, 0, "r", "t"), (1 << 40, 1, "r", "t")]  # the first of these families is absent
    assert run(spark, rows) == brute(rows)


def test_a_common_conversation_and_no_rows(spark):
    same = [(c, t, "user", f"turn {t}") for c in range(5000, 9500) for t in range(2)]
    assert run(spark, same) == brute(same)
    assert run(spark, []) == []
    assert run(spark, [(None, 1, "a", "b")]) == []


@pytest.mark.parametrize("length", [5, 64, 66])
def test_long_conversations_in_small_blocks(spark, length):
    rows = [(c, t, "u", "same" if t < length - 2 else f"end {c}") for c in (0, 1, 2) for t in range(length)] + [(3, t, "u", "same") for t in range(length // 2)]
    assert run(spark, rows, 4) == brute(rows)


def test_a_long_conversation(spark):
    rows = [(c, t, "u", f"{t % 3} w") for c in (0, 7) for t in range(300 + c)]
    assert run(spark, rows) == brute(rows)


def test_query_columns(spark):
    assert queries.QUERIES["op11_pointer_trie"](spark, "/root/testdata/sf0.001").columns == COLUMNS
