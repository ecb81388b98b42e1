"""Burrows-Wheeler transforms of collections of short strings, and their merge by interleave refinement.

A string is bytes 1..255 and a 0 that ends it; its rotations are compared as cyclic words. The
transform of a collection lists, for all rotations of all its strings in sorted order, the symbol
before each. It says all about the strings but what they are called: walking back from
the rotations that begin with a 0, which come first and in the order of the strings, visits each rotation.
"""

from __future__ import annotations

import numpy as np


def sorted_rotations(symbols: np.ndarray, first: np.ndarray, sizes: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Positions of all rotations in sorted order, by prefix doubling. first and sizes: of the string at each position.

    Rotations of different strings differ within the sum of their lengths, no sooner.
    """

    def moved(step: int) -> np.ndarray:
        return (offset + step) % sizes + first

    key = symbols.astype(np.uint64)
    for step in (1, 2, 4):
        key = key << np.uint64(8 * step) | key[moved(step)]
    depth, enough = 8, 2 * int(sizes.max())
    # As many ranks as 64 bits hold are sorted by at once: three or more, unless there are very many symbols.
    bits = max(1, int(len(symbols) - 1).bit_length())
    while True:
        order = np.argsort(key, kind="quicksort")
        run = key[order]
        rank = np.empty(len(run), np.uint64)
        rank[order] = np.concatenate([[0], np.cumsum(run[1:] != run[:-1])])
        if depth >= enough or int(rank[order[-1]]) == len(rank) - 1:
            return order
        key, times = rank, min(64 // bits, -(-enough // depth))
        for i in range(1, times):
            key = key << np.uint64(bits) | rank[moved(i * depth)]
        depth *= times


def transforms(strings: list[bytes], cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The transforms of each cell's (distinct) strings, cell by cell: (transform, cell of each symbol, strings in sorted order). One sort serves all cells."""
    symbols = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    sizes = np.fromiter(map(len, strings), np.int64, len(strings)) + 1
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    owner = np.repeat(np.arange(len(strings)), sizes)
    offset = np.arange(len(symbols)) - begin[owner]
    order = sorted_rotations(symbols, begin[owner], sizes[owner], offset)
    by = np.argsort(cells[owner[order]], kind="stable")
    order = order[by]
    mine = owner[order]
    before = symbols[(offset[order] - 1) % sizes[mine] + begin[mine]]
    return before, cells[mine], mine[offset[order] == sizes[mine] - 1]


def walked(transform: np.ndarray, part: np.ndarray, sizes: np.ndarray, string_part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rotation one symbol back, string, offset) of each rotation of collections that stand one after another.

    sizes and string_part: of all strings with their ends, in the order of parts and strings.
    """
    by = np.argsort(transform, kind="stable")
    by = by[np.argsort(part[by], kind="stable")]
    back = np.empty(len(transform), np.int64)
    back[by] = np.arange(len(transform))
    parts = np.arange(int(part[-1]) + 1)
    start, first = np.searchsorted(part, parts), np.searchsorted(string_part, parts)
    at = start[string_part] + np.arange(len(sizes)) - first[string_part]
    string, offset = np.empty(len(transform), np.int32), np.empty(len(transform), np.int32)
    long = np.argsort(-sizes, kind="stable")
    at, left = at[long], sizes[long] - 1
    for step in range(int(left[0]) + 1 if len(left) else 0):
        n = int(np.searchsorted(-left, -step, "right"))
        at, long = at[:n], long[:n]
        string[at], offset[at] = long, left[:n] - step
        at = back[at]
    return back, string, offset


def merge(back: np.ndarray, transform: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave sorted collections that stand one after another: (merged place of each rotation, common prefix of each place with the one before).

    back: for each rotation the one that begins a symbol earlier. Each step hands every merged place the four
    symbols before its rotation (the last step those that are left) and sorts the places stably by them; the
    rotation that begins four symbols earlier comes to stand there, and so the order is known four symbols
    deeper. Rotations are never compared. Common prefixes are counted in steps of four symbols, up to depth.
    """
    total = len(back)
    ahead, symbols = [np.arange(total)], [transform]
    for _ in range(4):
        ahead.append(back[ahead[-1]])
        symbols.append(transform[ahead[-1]])
    group, common = np.zeros(total, np.int32), np.full(total, depth, np.int32)
    common[:1] = 0
    cut, here = np.zeros(max(total - 1, 0), bool), np.arange(total, dtype=np.uint64)
    place, moved = np.arange(total), np.empty(total, np.int64)
    key = np.empty(total, np.uint64)
    for known in range(0, depth, 4):
        step = min(4, depth - known)
        if known == 0 or step < 4:
            word = symbols[step - 1].astype(np.uint64)
            for x in symbols[step - 2 :: -1] if step > 1 else ():
                word = word << np.uint64(8) | x
            word <<= np.uint64(32)
        # Places are the low half of the key, so sorting is stable and brings them along.
        key[place] = word
        key |= here
        key.sort()
        order = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        key >>= np.uint64(32)
        g = group[order]
        # Groups only split, and a boundary stays where it is: a new one has the prefix of the step before in common.
        new = (key[1:] != key[:-1]) | (g[1:] != g[:-1])
        common[1:][new & ~cut] = known
        cut = new
        np.cumsum(new, out=group[1:])
        moved[order] = np.arange(total)
        now = np.empty(total, np.int64)
        now[ahead[step]] = moved[place]
        place = now
    return place, common


def repeated_windows(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], width: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that also begin in a string with a smaller owner: (string, from, to, smallest owner), strings counted through all parts.

    parts: for each collection its transform, and of its strings in sorted order the sizes, the smallest
    and the largest owner. Where the common prefix reaches the width, the interval goes on.
    """
    none = np.iinfo(np.int64).max
    kind = np.uint8 if len(parts) < 256 else np.uint16 if len(parts) < 65_536 else np.uint32
    numbers = np.arange(len(parts), dtype=kind)
    transform = np.concatenate([p[0] for p in parts])
    sizes, least, most = (np.concatenate([p[i] for p in parts]).astype(np.int64) for i in (1, 2, 3))
    part = np.repeat(numbers, [len(p[0]) for p in parts])
    sizes += 1
    back, string, offset = walked(transform, part, sizes, np.repeat(numbers, [len(p[1]) for p in parts]))
    place, common = merge(back, transform, width)
    begins = common < width
    whole = offset + width < sizes[string]
    owner = np.empty(len(part), np.int64)
    owner[place] = np.where(whole, least[string], none)
    interval = np.cumsum(begins) - 1
    smallest = np.minimum.reduceat(owner, np.flatnonzero(begins))[interval[place]]
    lost = whole & (smallest < most[string])
    # Laid out by string and offset again; windows that don't fit, at the end of each string, keep strings apart.
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    laid = np.full(len(part), none)
    laid[first[string[lost]] + offset[lost]] = smallest[lost]
    run = np.flatnonzero(np.concatenate([[True], laid[1:] != laid[:-1]]))
    end = np.append(run[1:], len(laid))
    kept = laid[run] != none
    run, end = run[kept], end[kept]
    of = np.searchsorted(first, run, "right") - 1
    return of, run - first[of], end - first[of], laid[run]
