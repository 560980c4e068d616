"""Plain, slow versions of the operators, for comparison on small inputs."""

import hashlib
import re
from collections import Counter

import xxhash


def repeated_strings(texts: list[bytes], length: int = 200):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text."""
    seen: Counter = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def exact_groups(rows: list[tuple]):
    """(doc_id, keep_id, group_size, kept, text_sha256) in the order of rows (doc_id, text)."""
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    groups: dict = {}
    for i, n in enumerate(norm):
        groups.setdefault(n, []).append(i)
    out = [None] * len(rows)
    for n, held in groups.items():
        best = min(held, key=lambda i: (-len(rows[i][1] or ""), rows[i][0] is None, rows[i][0] or 0, i))
        for i in held:
            out[i] = (rows[i][0], rows[best][0], len(held), i == best, hashlib.sha256(n.encode()).hexdigest())
    return out


def fingerprint(text: str, words: int = 3) -> int:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    tokens = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids: list, fps: list[int], bits: int = 2):
    """Smallest id reachable from each row over fingerprints at most ``bits`` apart."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    least: dict = {}
    for i in range(len(fps)):
        r = find(i)
        least[r] = min(least.get(r, ids[i]), ids[i])
    return [least[find(i)] for i in range(len(fps))]


def similar_components(rows, words, similarity):
    """Smallest id reached from each row over pairs whose shingle sets are similar."""
    sets = []
    for _, text in rows:
        t = (text or "").encode().lower().split()
        sets.append({tuple(t[i : i + words]) for i in range(max(1, len(t) - words + 1))})
    label = [i for i, _ in rows]
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if label[i] != label[j] and len(a & b) >= similarity * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label
