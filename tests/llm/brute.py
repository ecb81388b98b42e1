"""Plain Python versions of what the operators compute."""

import hashlib
import re
import struct
import zlib
from collections import defaultdict
from itertools import combinations

import regex
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near(rows):
    """doc_id -> (shingles, component) over all pairs."""
    sets = {d: shingle_set(t) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), root(d)) for d in sets}


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def substrings(rows, width=50):
    """[(doc_id, bytes, removed, spans, sha)] sorted."""
    rows = [(d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, b in sorted(rows, key=lambda r: r[0]):
        for i in range(len(b) - width + 1):
            first.setdefault(b[i : i + width], d)
    out = []
    for d, b in rows:
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if first[b[i : i + width]] < d:
                gone[i : i + width] = b"\1" * width
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return sorted(out)


def lines(rows):
    space = " \t\n\x0b\x0c\r"
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    split = [(d, (t or "").split("\n")) for d, t in rows]
    holders = defaultdict(set)
    for d, ls in split:
        for x in ls:
            k = low(x.strip(space))
            if len(k) >= 20:
                holders[k].add(d)
    lost = {k: max(v) for k, v in holders.items() if len(v) >= 3}
    out = []
    for d, ls in split:
        kept = [x for x in ls if (k := low(x.strip(space))) not in lost or lost[k] == d]
        out.append((d, len(ls), len(ls) - len(kept), sha("\n".join(kept))))
    return sorted(out)


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secrets(text):
    t = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))


def pieces(ids, capacity=4096):
    import numpy as np

    data = np.array(ids, "<u4").tobytes()
    return [(n, at, len(data[4 * at : 4 * (at + capacity)]) // 4, zlib.crc32(data[4 * at : 4 * (at + capacity)])) for n, at in enumerate(range(0, len(ids), capacity))]


UNIT = regex.compile(r"\p{Ideographic}|[^ \t\n\x0b\f\r\p{Ideographic}]{1,24}")


def hashed(*values, seed=42):
    """Spark's xxhash64 of strings and longs: each value's hash is the next one's seed."""
    for v in values:
        seed = xxhash.xxh64(v.encode() if isinstance(v, str) else struct.pack("<q", v), seed=seed % 2**64).intdigest()
    return seed - 2**64 if seed >= 2**63 else seed


def syncmers(text, k=5, s=2):
    """Hashes of the closed syncmers over units, in order."""
    units = [hashed(u) for u in UNIT.findall(text)]
    inner = [hashed(*units[i : i + s]) for i in range(len(units) - s + 1)]
    out = []
    for i in range(len(units) - k + 1):
        window = inner[i : i + k - s + 1]
        if min(window) in (window[0], window[-1]):
            out.append(hashed(window[0], units[i + s], window[-1]) % 2**64 >> 33)
    return out or ([hashed(*units) % 2**64 >> 33] if units else [])


def alike(a, b):
    a, b = set(a), set(b)
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


def prints(rows):
    """[(doc_id, n_chars, sha of the edited text, fingerprint, its fingerprint, likeness to it, to the next)] sorted."""
    order = [(d, t or "") for d, t in sorted(rows, key=lambda r: -r[0])]
    text = lambda a: ".".join(f"{h:x}" for h in a)
    out = []
    for i, (d, t) in enumerate(order):
        after, half = order[(i + 1) % len(order)][1], len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        own, other = syncmers(t), syncmers(edited)
        out.append((d, len(t), sha(edited), text(own), text(other), round(alike(own, other), 9), round(alike(own, syncmers(after)), 9)))
    return sorted(out)
