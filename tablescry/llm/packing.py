"""Best-fit packing of tokenised documents with a swap-based local search.

Documents become token ids and an end mark; only documents longer than a sequence
are cut. Pieces are dealt by hash into groups of bounded expected size, packed
best fit first; then underfull bins exchange pieces - moved, one for one, or two for
one - whenever that makes the fuller bin fuller, which raises the sum of squared
fills, until bins empty and no exchange helps. Sequences left with room from all groups
meet again in further rounds, so the loss doesn't grow with the number of groups.

Defined results: a null or empty text is the end mark alone; repeated rows and
repeated or null ids are documents of their own; an empty table gives an empty
result; other columns of the input are ignored. Whole texts are tokenised: the text
is split at ASCII white space, which the tokenizer's own normaliser and pattern never
reach across, and the ids of each distinct chunk are remembered.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, save, text_of

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long, room long"


def pieces(docs: DataFrame, tokenizer_path: str, *, capacity: int = 4096, end_id: int = 1, remembered: int = 600_000, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32 and, if wanted, ids. The tokenizer file is read here and sent along."""
    bound_batches(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import sys
        import types
        import zlib

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import Tokenizer

        # Kept from task to task of one worker process.
        state = sys.modules.setdefault("_tablescry_tokens", types.ModuleType("_tablescry_tokens")).__dict__
        key = hash(model.value)
        if state.get("key") != key:
            state |= {"key": key, "tokenizer": Tokenizer.from_str(model.value), "new": {}, "old": {}}
        encode, known, old = state["tokenizer"].encode_batch_fast, state["new"], state["old"]
        end, wide = end_id.to_bytes(4, "little"), 4 * capacity
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                data = text.as_buffer().to_pybytes()
                # The tokenizer lower-cases all but its special tokens, which begin with <|, but composes letters with
                # marks (U+0300 to U+036F, first byte CC or CD) before that: H and U+0331 stay two, h and U+0331 don't.
                if b"<|" in data:
                    chunks = data.split()
                elif b"\xcc" in data or b"\xcd" in data:
                    chunks = [c.lower() if c.isascii() else c for c in data.split()]
                else:
                    chunks = data.lower().split()
                new = set(chunks).difference(known)
                if new:
                    if len(known) + len(new) > remembered:  # two generations: what is still in use moves on
                        old, known = known, {}
                        state |= {"new": known, "old": old}
                        new = set(chunks)
                    again = [c for c in new if c in old]
                    known.update((c, old[c]) for c in again)
                    new.difference_update(again)
                    # A word and the mark after it are tokens apart, by the tokenizer's pattern.
                    marked = [c for c in new if c[-1:] in (b".", b",") and c[:-1].isalpha()]
                    new.difference_update(marked)
                    new.update(w for c in marked for w in (c[:-1], c[-1:]) if w not in known)
                    todo = list(new)
                    for lo in range(0, len(todo), 10_000):
                        part = todo[lo : lo + 10_000]
                        for c, e in zip(part, encode([c.decode("utf-8", "replace") for c in part], add_special_tokens=False)):
                            known[c] = np.array(e.ids, "<u4").tobytes()
                    for c in marked:
                        known[c] = known[c[:-1]] + known[c[-1:]]
                ids = b"".join([known[c] for c in chunks]) + end
                for n, at in enumerate(range(0, len(ids), wide)):
                    cut = ids[at : at + wide]
                    for column, v in zip(out, (doc_id, n, at // 4, len(cut) // 4, zlib.crc32(cut), np.frombuffer(cut, "<i4"))):
                        column.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            width = 5 + with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in list(zip(out, kinds))[:width]], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:width])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(tokenise, PIECES + ", ids array<int>" * with_ids)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices: longest first, each into the fullest bin with room. The rooms in use are bits of one number."""
    by_room: dict[int, list[list[int]]] = {}
    rooms, bins = 0, []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        above = rooms >> n
        if above:
            room = n + (above & -above).bit_length() - 1
            stack = by_room[room]
            target = stack.pop()
            if not stack:
                rooms &= ~(1 << room)
        else:
            room, target = capacity, []
            bins.append(target)
        target.append(i)
        if left := room - n:
            by_room.setdefault(left, []).append(target)
            rooms |= 1 << left
    return bins


class Pool:
    """What bins offer, by length: lengths there are as bits of one number, and for each the bins and pieces. Offers of a bin that has changed are stale."""

    def __init__(self):
        self.bits, self.offers, self.version = 0, {}, {}

    def offer(self, length: int, bin_: int, pieces: tuple[int, ...]) -> None:
        self.offers.setdefault(length, []).append((bin_, self.version.get(bin_, 0), pieces))
        self.bits |= 1 << length

    def changed(self, bin_: int) -> None:
        self.version[bin_] = self.version.get(bin_, 0) + 1

    def longest(self, most: int, over: int) -> tuple[int, int, tuple[int, ...]] | None:
        """(length, bin, pieces) of the longest offer up to most and over the other length."""
        while (n := (self.bits & ((2 << most) - 1)).bit_length() - 1) > over:
            stack = self.offers[n]
            while stack:
                bin_, version, pieces = stack[-1]
                if version == self.version.get(bin_, 0):
                    return n, bin_, pieces
                stack.pop()
            self.bits &= ~(1 << n)
        return None


def improve(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Exchange pieces between underfull bins while that raises the sum of squared fills; bins that empty are gone.

    Bins are taken from the fullest down, and each may draw on all after it: it takes the
    piece that fills it best, gives one for it, or swaps two for one or one for two. What all bins offer is
    indexed by length, so a pass takes time in proportion to the pieces; passes go on
    until one changes nothing or no bin can be saved. Every exchange makes the fuller of
    two bins fuller, which can't go on for ever.
    """
    fill = [sum(lengths[i] for i in b) for b in bins]
    least, alive = -(-sum(fill) // capacity), sum(map(bool, bins))
    moved = True
    while moved and alive > least:
        moved = False
        ones, twos = Pool(), Pool()

        def add(n: int) -> None:
            by_length: dict[int, list[int]] = {}
            for i in bins[n]:
                by_length.setdefault(lengths[i], []).append(i)
            for x, same in by_length.items():
                ones.offer(x, n, (same[0],))
            every = sorted(by_length)
            for at, x in enumerate(every):
                for y in every[at:]:
                    if x + y > capacity:
                        break
                    pair = (by_length[x][0], by_length[y][-1])
                    if pair[0] != pair[1]:
                        twos.offer(x + y, n, pair)

        def exchange(target: int) -> tuple | None:
            """(gain, source, pieces that come, pieces that go) of the exchange that fills the bin most."""
            room, best = capacity - fill[target], None
            single = {lengths[i]: i for i in bins[target]}
            double = {lengths[i] + lengths[j]: (i, j) for i, j in combinations(single.values(), 2)}
            for back in ((), *((i,) for i in single.values()), *double.values()):
                given = sum(lengths[i] for i in back)
                for pool in (ones, twos) if len(back) == 1 else (ones,):
                    most = given + room
                    while found := pool.longest(most, given + (best[0] if best else 0)):
                        gain = found[0] - given
                        if fill[found[1]] < fill[target] + gain:
                            best = (gain, found[1], found[2], back)
                            break
                        most = found[0] - 1  # that bin is so full that nothing is won
                    if best and best[0] == room:
                        return best
            return best

        open_ = sorted((n for n, b in enumerate(bins) if b and fill[n] < capacity), key=lambda n: (-fill[n], n))
        for n in open_:
            add(n)
        for target in open_:
            for pool in (ones, twos):
                pool.changed(target)
            while bins[target] and fill[target] < capacity and (found := exchange(target)):
                gain, source, come, go = found
                bins[target] = [i for i in bins[target] if i not in go] + list(come)
                bins[source] = [i for i in bins[source] if i not in come] + list(go)
                fill[target] += gain
                fill[source] -= gain
                moved = True
                for pool in (ones, twos):
                    pool.changed(source)
                add(source)
                alive -= not bins[source]
    return [b for b in bins if b]


def pack(rows: DataFrame, *, capacity: int = 4096, group_rows: int = 16_384) -> DataFrame:
    """The pieces with sequence_id, offset (gapless from 0) and room (what is left of their sequence).

    A round's sequences with more than a 256th of room are dealt again in the next. That
    ends when one group has held them all, or a round saved less than one sequence a group.
    """
    spare = capacity // 256

    def packer(turn: int):
        def pack_group(table: pa.Table) -> pa.Table:
            table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
            lengths = table.column("length").to_pylist()
            bins = improve(best_fit(lengths, capacity), lengths, capacity)
            group = table.column("group")[0].as_py()
            n = len(lengths)
            sequence, offset, room = [0] * n, [0] * n, [0] * n
            for b, members in enumerate(bins):
                at = 0
                for i in sorted(members):
                    sequence[i], offset[i] = (turn << 46) | (group << 20) | b, at
                    at += lengths[i]
                for i in members:
                    room[i] = capacity - at
            out = table.select(["doc_id", "piece", "start", "length", "ids_crc32"])
            for name, column in (("sequence_id", sequence), ("offset", offset), ("room", room)):
                out = out.append_column(name, pa.array(column, pa.int64()))
            return out

        return pack_group

    def open_sequences(packed: DataFrame) -> tuple[int, int]:
        """Pieces and sequences that are to be dealt again; the piece at offset 0 stands for its sequence."""
        r = packed.where(F.col("room") > spare).agg(F.count("*"), F.count_if(F.col("offset") == 0)).first()
        return r[0], r[1]

    done, left, count, sequences, turn = None, rows, rows.count(), None, 0
    while True:
        groups = max(1, -(-count // group_rows))
        dealt = left.withColumn("group", F.pmod(F.xxhash64(F.lit(turn), "doc_id", "piece", "ids_crc32"), F.lit(groups)))
        packed = save(dealt.groupBy("group").applyInArrow(packer(turn), PACKED), "packed")
        used = packed.where(F.col("offset") == 0).count()
        last = groups == 1 or (sequences is not None and sequences - used < groups)
        kept = packed if last else packed.where(F.col("room") <= spare)
        done = kept if done is None else done.unionByName(kept)
        if last:
            return done
        count, sequences = open_sequences(packed)
        if not count:
            return done
        left = packed.where(F.col("room") > spare).select("doc_id", "piece", "start", "length", "ids_crc32")
        turn += 1


def packed_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """The digest for the query."""
    rows = save(pieces(docs, tokenizer_path), "pieces")
    return pack(rows).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
