"""Exact substring deduplication: repeated intervals from merged Burrows-Wheeler transforms.

A byte goes when a string of `width` bytes that covers it also starts in a document
with a smaller id. Every window of that width has an anchor, its gram of 20 bytes with
the least hash, so equal windows have equal anchors; neighbouring windows with one
anchor form a piece. Documents are packed in shards, and anchors are dealt over buckets:

Documents that equal one with a smaller id lose all and are set aside first, by hash.

1. each shard sends its distinct anchors with a print of the piece around each; buckets
   tell which occur in two documents, and where the pieces differ;
2. where all pieces around an anchor are equal, there is nothing to compare: each shard
   sends the smallest and largest id. Where they differ, the shard sorts its own pieces and
   sends their transform, in cells of bounded size;
3. buckets merge the transforms of all shards, cell by cell, by interleave refinement, without
   sorting a suffix again; intervals of places with common prefixes of the full
   width are equal windows, and the smallest id of each is kept;
4. each shard gets the runs of windows that it loses back and cuts its documents.

An anchor with very many different pieces (a common word among ever new neighbours) would
make a cell that no task can hold. Its windows are dealt over all buckets by their own
128-bit hash instead.

What moves is eleven bytes an anchor, two ids for a repeated piece and a byte a symbol of
what is merged; the shards are a table bucketed by their number and stay in place, and nothing is
gathered on the driver.

Defined results: a null text is empty; a null id ranks last; rows that share an id
don't remove from each other; texts shorter than the window stay; an empty table gives
an empty result; other columns are ignored. Texts are UTF-8, as Spark's strings are: byte 255,
which isn't part of it, stands in for 0 in the transforms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bwt import repeated_windows, transforms
from .common import bound_batches, delete, partitions, save, save_by, scanned_bytes, text_of

GRAM = 20
#: Bytes of input for which there is a bucket, beside the ones that there are shuffle partitions.
BUCKET_BYTES = 64 << 20
#: Windows of one piece at most; text that repeats itself would make endless ones.
PIECE = 64
#: Symbols that are merged at once, about; anchors are independent of each other, so whole anchors make up a cell.
MERGE = 250_000
#: Bytes 0 and 255 change places.
SWAP = bytes([255, *range(1, 255), 0])
LAST = np.iinfo(np.int64).max
RESULT = "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept_sha256 string"


def pack(*arrays, level: int = 1) -> bytes:
    import pickle

    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(pickle.dumps(arrays, protocol=5))


def unpack(data: bytes):
    import pickle

    import zstandard

    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def stirred(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def anchored(data: bytes, sizes: np.ndarray, width: int, block: int = 1 << 19) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of documents laid end to end: first window, number of windows, anchor."""
    whole = np.frombuffer(data, np.uint8)
    ends = np.cumsum(sizes)
    span = width - GRAM + 1
    found = []
    for lo in range(0, len(whole), block):
        hi = min(len(whole), lo + block)
        v = np.zeros(hi - lo + width + 8, np.uint64)
        here = whole[lo : hi + width]
        v[: len(here)] = here
        two = v[:-1] | v[1:] << np.uint64(8)
        four = two[:-2] | two[2:] << np.uint64(16)
        eight = four[:-4] | four[4:] << np.uint64(32)
        n = hi - lo + span - 1
        low = stirred(stirred(stirred(eight[:n]) + eight[8 : n + 8]) + four[16 : n + 16])
        reach = 1
        while reach * 2 <= span:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if rest := span - reach:
            low = np.minimum(low[:-rest], low[rest:])
        at = np.arange(lo, hi)
        first, last = np.searchsorted(ends, lo, "right"), np.searchsorted(ends, hi - 1, "right")
        limit = np.repeat(ends[first : last + 1], np.minimum(ends[first : last + 1], hi) - np.maximum(np.concatenate([[0], ends])[first : last + 1], lo))
        inside = at + width <= limit
        new = inside.copy()
        new[1:] &= (low[1:] != low[:-1]) | ~inside[:-1]
        starts = np.flatnonzero(new)
        stops = np.flatnonzero(inside & np.concatenate([new[1:] | ~inside[1:], [True]])) + 1
        counts = stops - starts
        times = -(-counts // PIECE)
        if len(times) and times.max() > 1:
            part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            starts, counts = np.repeat(starts, times) + part * PIECE, np.minimum(np.repeat(counts, times) - part * PIECE, PIECE)
        found.append((starts + lo, counts, low[starts]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return tuple(np.concatenate(c) for c in zip(*found))


def split_anchor(anchor: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket, and 32 bits that tell anchors of a bucket apart (a rare clash only costs work)."""
    return ((anchor >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32), anchor.astype(np.uint32)


def packed(docs: DataFrame, width: int, shard_bytes: int) -> DataFrame:
    """shard, ids, prints (128-bit hashes of texts no shorter than the window), data."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        number, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal number, ids, texts, held
            order = [LAST if i is None else i for i in ids]
            prints = [xxhash.xxh3_128_digest(t) if len(t) >= width else None for t in texts]
            data = pack(ids, np.fromiter(map(len, texts), np.int64, len(texts)), b"".join(texts))
            row = [pa.array([number], pa.int64()), pa.array([order], pa.list_(pa.int64())), pa.array([prints], pa.list_(pa.binary())), pa.array([data], pa.binary())]
            number, ids, texts, held = number + 1, [], [], 0
            return pa.RecordBatch.from_arrays(row, ["shard", "ids", "prints", "data"])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids.append(doc_id)
                texts.append(text.as_buffer().to_pybytes())
                held += len(texts[-1])
                if held >= shard_bytes:
                    yield close()
        if ids:
            yield close()

    return docs.mapInArrow(work, "shard long, ids array<long>, prints array<binary>, data binary")


def copies(shards: DataFrame) -> DataFrame:
    """shard, copies: places of documents that equal one with a smaller id. They go whole, so nothing more is asked of them."""
    each = shards.select("shard", F.posexplode(F.arrays_zip("ids", "prints")).alias("place", "x")).select("shard", "place", F.col("x.ids").alias("id"), F.col("x.prints").alias("print")).where("print is not null")
    # Written first: what very many documents equal is one row here, and the join needn't gather them.
    first = save(each.groupBy("print").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1"), "bwt-first")
    return each.join(first, "print").where("id > least").groupBy("shard").agg(F.collect_list("place").alias("copies"))


def opened(data: pa.Scalar, gone: list | None) -> tuple[list, np.ndarray, np.ndarray, bytes, np.ndarray]:
    """ids, order, sizes (0 of copies), the text without copies, and which documents are copies."""
    ids, sizes, text = unpack(data.as_buffer())
    copy = np.zeros(len(ids), bool)
    if gone:
        copy[gone] = True
        ends = np.cumsum(sizes)
        text = b"".join([text[z - n : z] for z, n, c in zip(ends.tolist(), sizes.tolist(), copy.tolist()) if not c])
    return ids, np.array([LAST if i is None else i for i in ids], np.int64), np.where(copy, 0, sizes), text, copy


def grams8(text: bytes) -> np.ndarray:
    """Stirred words of eight bytes, one at each place, zeros past the end."""
    v = np.zeros(len(text) + 8, np.uint64)
    v[: len(text)] = np.frombuffer(text, np.uint8)
    two = v[:-1] | v[1:] << np.uint64(8)
    four = two[:-2] | two[2:] << np.uint64(16)
    return stirred(stirred(four[:-4] | four[4:] << np.uint64(32)))


class Prints:
    """Hashes of any substrings of a text, eight bytes at least, by differences of prefix sums of place-weighted words."""

    def __init__(self, text: bytes):
        self.words = grams8(text)

    def of(self, start: np.ndarray, size: np.ndarray, factor: int) -> np.ndarray:
        n = len(self.words)
        weight = np.cumprod(np.full(n, factor, np.uint64)) if n else np.empty(0, np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.words * weight, dtype=np.uint64)])
        inverse = np.cumprod(np.full(n, pow(factor, -1, 1 << 64), np.uint64)) if n else weight
        whole = (sums[start + size - 7] - sums[start]) * inverse[start]
        return stirred(stirred(whole) ^ size.astype(np.uint64))


FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def keyed(text: bytes, sizes: np.ndarray, width: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all pieces: first window, number of windows, key (bucket and 32 bits of the anchor), print of 48 bits."""
    start, count, anchor = anchored(text, sizes, width)
    bucket, low = split_anchor(anchor, buckets)
    prints = Prints(text).of(start, count + (width - 1), FACTORS[0]) >> np.uint64(16) if len(start) else anchor
    return start, count, bucket.astype(np.uint64) << np.uint64(32) | low, prints


def firsts(sorted_keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.empty(0, np.int64)


def bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    return np.searchsorted(keys, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))


def rows_of(out: list[tuple], columns: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(columns.values())], list(columns))


SENT = {"shard": pa.int64(), "bucket": pa.int32(), "data": pa.binary()}


def anchors(rows: DataFrame, buckets: int, width: int) -> DataFrame:
    """shard, bucket, data: of the distinct anchors of a shard, the print and number of pieces and whether two documents hold them. rows: shard, data, copies."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for shard, data, gone in zip(b.column("shard").to_pylist(), b.column("data"), b.column("copies").to_pylist()):
                _, order, sizes, text, _ = opened(data, gone)
                start, _, key, prints = keyed(text, sizes, width, buckets)
                owner = order[np.searchsorted(np.cumsum(sizes), start, "right")]
                by = np.lexsort((prints, key))
                key, owner, prints = key[by], owner[by], prints[by]
                first = firsts(key)
                if not len(first):
                    continue
                several = np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)
                other = np.concatenate([[False], (key[1:] == key[:-1]) & (prints[1:] != prints[:-1])])
                pieces_ = 1 + np.add.reduceat(other.astype(np.int64), first)
                key, prints = key[first], prints[first]
                cuts = bounds(key, buckets)
                for k in range(buckets):
                    if cuts[k] < cuts[k + 1]:
                        part = slice(cuts[k], cuts[k + 1])
                        many = np.minimum(pieces_[part], 255).astype(np.uint8)
                        flags = several[part], many > 1
                        out.append((shard, k, pack(key[part].astype(np.uint32), prints[part].astype(np.uint32), (prints[part] >> np.uint64(32)).astype(np.uint16), *map(np.packbits, flags), many[many > 1])))
            yield rows_of(out, SENT)

    return rows.select("shard", "data", "copies").mapInArrow(work, "shard long, bucket int, data binary")


def shared_anchors(large: int):
    def work(table: pa.Table) -> pa.Table:
        """Of one bucket: for each shard what its anchors are (0: in one document, 1: one piece, 2: different pieces, 3: very many), and the number of cells."""
        sent = []
        for data in table.column("data"):
            low, p, q, several, mixed, many = unpack(data.as_buffer())
            count = np.ones(len(low), np.int64)
            mixed = np.unpackbits(mixed, count=len(low)).astype(bool)
            count[mixed] = many
            sent.append((low, p.astype(np.uint64) | q.astype(np.uint64) << np.uint64(32), np.unpackbits(several, count=len(low)).astype(bool), count))
        low, prints, several, count = (np.concatenate(c) for c in zip(*sent))
        by = np.lexsort((prints, low))
        first = firsts(low[by])
        number = np.empty(len(low), np.int64)
        number[by] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(low))))
        shared = np.diff(np.append(first, len(low))) > 1
        np.logical_or.at(shared, number[several], True)
        apart = np.minimum.reduceat(prints[by], first) != np.maximum.reduceat(prints[by], first)
        np.logical_or.at(apart, number[count > 1], True)
        pieces_ = np.bincount(number, count, len(first))
        kind = np.where(~shared, 0, np.where(~apart, 1, np.where(pieces_ <= large, 2, 3))).astype(np.uint8)
        cells = max(1, -(-int(pieces_[kind == 2].sum()) * 70 // MERGE))
        ends = np.cumsum([len(s[0]) for s in sent])
        kinds = [pack(kind[number[z - len(s[0]) : z]], cells) for s, z in zip(sent, ends)]
        return pa.table({"shard": table.column("shard"), "bucket": table.column("bucket"), "kinds": pa.array(kinds, pa.binary())})

    return work


def pieces(rows: DataFrame, buckets: int, width: int) -> DataFrame:
    """shard, bucket (null: where the shard's pieces stand), data. rows: shard, data, copies, told (bucket and kinds)."""

    def of_shard(data, gone, told) -> tuple[bytes, list[tuple[int, bytes]]]:
        _, order, sizes, text, _ = opened(data, gone)
        start, count, key, _ = keyed(text, sizes, width, buckets)
        owner = order[np.searchsorted(np.cumsum(sizes), start, "right")]
        distinct = np.unique(key)
        cuts = bounds(distinct, buckets)
        kind, cells = np.zeros(len(distinct), np.uint8), np.ones(buckets, np.int64)
        for m in told or ():
            kind[cuts[m["bucket"]] : cuts[m["bucket"] + 1]], cells[m["bucket"]] = unpack(m["kinds"])
        kind = kind[np.searchsorted(distinct, key)]
        sent: dict[int, list] = {}

        def ids_of(number: np.ndarray, owners: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
            least, most = np.full(n, LAST), np.full(n, np.iinfo(np.int64).min)
            np.minimum.at(least, number, owners)
            np.maximum.at(most, number, owners)
            return least, most

        # One piece: what the anchor is called, and its ids.
        one = kind == 1
        names, plain = np.unique(key[one], return_inverse=True)
        least, most = ids_of(plain, owner[one], len(names))
        plain_cuts = bounds(names, buckets)
        for k in np.flatnonzero(np.diff(plain_cuts)).tolist():
            part = slice(plain_cuts[k], plain_cuts[k + 1])
            sent.setdefault(k, [None, None, None])[0] = (names[part].astype(np.uint32), least[part], most[part])

        # Different pieces: the transform of this shard's, by bucket and cell.
        two = kind == 2
        by = np.flatnonzero(two)[np.argsort(key[two] >> np.uint64(32), kind="stable")]
        number: dict[bytes, int] = {}
        swapped = text.translate(SWAP)
        string = np.fromiter((number.setdefault(swapped[a:z], len(number)) for a, z in zip(start[by].tolist(), (start[by] + count[by] + (width - 1)).tolist())), np.int64, len(by))
        strings = list(number)
        keys = np.zeros(len(strings), np.uint64)
        keys[string] = key[by]
        bucket = (keys >> np.uint64(32)).astype(np.int64)
        string_cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        if strings:
            least, most = ids_of(string, owner[by], len(strings))
            cell = (stirred(keys) % cells[bucket].astype(np.uint64)).astype(np.int64)
            where, place = np.unique(np.stack([bucket, cell], 1), axis=0, return_inverse=True)
            before, at, members = transforms(strings, place.reshape(-1).astype(np.uint16 if len(where) < 65_536 else np.uint32))
            lengths = np.fromiter(map(len, strings), np.int64, len(strings))
            symbols, counts = np.bincount(at, minlength=len(where)), np.bincount(place.reshape(-1), minlength=len(where))
            s_end, m_end = np.cumsum(symbols), np.cumsum(counts)
            for k in np.unique(where[:, 0]).tolist():
                i = np.flatnonzero(where[:, 0] == k)
                mine = members[m_end[i[0]] - counts[i[0]] : m_end[i[-1]]]
                sent.setdefault(k, [None, None, None])[1] = (
                    where[i, 1], symbols[i], counts[i], before[s_end[i[0]] - symbols[i[0]] : s_end[i[-1]]],
                    lengths[mine].astype(np.uint16), (mine - string_cuts[k]).astype(np.int32), least[mine], most[mine],
                )

        # Very many pieces: each window by its own hash, wherever that belongs.
        three = kind == 3
        at = np.repeat(start[three], count[three]) + (np.arange(count[three].sum()) - np.repeat(np.cumsum(count[three]) - count[three], count[three]))
        prints = Prints(text)
        a, b = (prints.of(at, np.full(len(at), width), f) for f in FACTORS) if len(at) else (np.empty(0, np.uint64),) * 2
        to = ((a >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        by3 = np.lexsort((b, a, to))
        new = np.concatenate([[True], (a[by3][1:] != a[by3][:-1]) | (b[by3][1:] != b[by3][:-1])]) if len(at) else np.empty(0, bool)
        window = np.empty(len(at), np.int64)
        window[by3] = np.cumsum(new) - 1
        first = by3[new]
        least, most = ids_of(window, np.repeat(owner[three], count[three]), len(first))
        window_cuts = np.searchsorted(to[first], np.arange(buckets + 1))
        for k in np.flatnonzero(np.diff(window_cuts)).tolist():
            part = slice(window_cuts[k], window_cuts[k + 1])
            sent.setdefault(k, [None, None, None])[2] = (a[first[part]], b[first[part]], least[part], most[part])

        # where things stand: of each kind the thing, its first window and (plain ones) the number of windows, and where each bucket's begin
        places = pack((plain, start[one], count[one], plain_cuts), (string, start[by], None, string_cuts), (window, at, None, window_cuts))
        return places, [(k, pack(*v)) for k, v in sent.items()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for shard, data, gone, told in zip(b.column("shard").to_pylist(), b.column("data"), b.column("copies").to_pylist(), b.column("told")):
                places, sent = of_shard(data, gone, told.as_py())
                out.append((shard, None, places))
                out += [(shard, k, v) for k, v in sent]
            yield rows_of(out, SENT)

    return rows.select("shard", "data", "copies", "told").mapInArrow(work, "shard long, bucket int, data binary")


FOUND = "shard long, bucket int, runs binary, by_piece long, by_merge long, by_window long"


def merged(width: int):
    def smallest(sent: list, names: int) -> list[tuple | None]:
        """Of things sent by name: for each sender the ones that some of its documents lose, with the smallest id."""
        there = [i for i, s in enumerate(sent) if s]
        out: list[tuple | None] = [None] * len(sent)
        if there:
            name = [np.concatenate([sent[i][j] for i in there]) for j in range(names)]
            least, most = (np.concatenate([sent[i][names + j] for i in there]) for j in (0, 1))
            by = np.lexsort(name[::-1])
            new = np.concatenate([[True], np.any([n[by][1:] != n[by][:-1] for n in name], axis=0)])
            low = np.empty(len(by), np.int64)
            low[by] = np.minimum.reduceat(least[by], np.flatnonzero(new))[np.cumsum(new) - 1]
            end = 0
            for i in there:
                n = len(sent[i][0])
                mine = slice(end, end + n)
                lost = np.flatnonzero(low[mine] < most[mine])
                out[i] = (lost.astype(np.int32), low[mine][lost])
                end += n
        return out

    def work(table: pa.Table) -> pa.Table:
        """Of one bucket: for each shard the pieces, runs of windows and windows that some of its documents lose."""
        sent = [unpack(data.as_buffer()) for data in table.column("data")]
        plain, windows = smallest([s[0] for s in sent], 1), smallest([s[2] for s in sent], 2)
        cells: dict[int, list[tuple]] = {}
        for i, (_, t, _) in enumerate(sent):
            if t:
                number, symbols, counts, before, *of = t
                s_end, m_end = np.cumsum(symbols), np.cumsum(counts)
                for c, n, m, z, e in zip(number.tolist(), symbols.tolist(), counts.tolist(), s_end.tolist(), m_end.tolist()):
                    cells.setdefault(c, []).append((i, before[z - n : z], *(x[e - m : e] for x in of)))
        runs: list[list] = [[] for _ in sent]
        for parts in cells.values():
            string, lo, hi, low = repeated_windows([(before, sizes, least, most) for _, before, sizes, _, least, most in parts], width)
            name = np.concatenate([p[3] for p in parts])[string]
            cuts = np.searchsorted(string, np.concatenate([[0], np.cumsum([len(p[3]) for p in parts])]))
            for p, z, e in zip(parts, cuts, cuts[1:]):
                if z < e:
                    runs[p[0]].append((name[z:e], lo[z:e].astype(np.int16), hi[z:e].astype(np.int16), low[z:e]))
        joined = [tuple(map(np.concatenate, zip(*r))) if r else None for r in runs]
        count = lambda xs: pa.array([len(x[0]) if x else 0 for x in xs], pa.int64())
        return pa.table({
            "shard": table.column("shard"), "bucket": table.column("bucket"), "runs": pa.array([pack(*x) for x in zip(plain, joined, windows)], pa.binary()),
            "by_piece": count(plain), "by_merge": count(joined), "by_window": count(windows),
        })

    return work


def cut(rows: DataFrame, width: int, with_text: bool) -> DataFrame:
    """The documents of each shard without what they lose. rows: shard, data, copies, places, found (bucket and runs)."""

    def spans_of(batch: pa.RecordBatch) -> Iterator[tuple]:
        for data, gone_, places, found in zip(batch.column("data"), batch.column("copies").to_pylist(), batch.column("places"), batch.column("found")):
            ids, order, sizes, text, copy = opened(data, gone_)
            full = unpack(data.as_buffer())[1]
            ends = np.cumsum(sizes)
            change = np.zeros(len(text) + 1, np.int32)
            if places.is_valid and found.is_valid:
                told = [(f["bucket"], unpack(f["runs"])) for f in found.as_py()]
                for kind, (thing, start, count, cuts) in enumerate(unpack(places.as_buffer())):
                    by = np.argsort(thing, kind="stable")
                    first = np.searchsorted(thing[by], np.arange(cuts[-1] + 1))
                    for bucket, answer in told:
                        if answer[kind] is None:
                            continue
                        local, *run_, least = answer[kind]
                        p = local.astype(np.int64) + cuts[bucket]
                        n = first[p + 1] - first[p]
                        run = np.repeat(np.arange(len(p)), n)
                        at = by[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[p], n)]
                        lo, hi = (x[run] for x in run_) if run_ else (0, 1 if count is None else count[at])
                        spot = start[at]
                        gone = least[run] < order[np.searchsorted(ends, spot, "right")]
                        np.add.at(change, (spot + lo)[gone], 1)
                        np.add.at(change, (spot + hi - 1 + width)[gone], -1)
            lost = np.cumsum(change[:-1]) > 0
            whole = np.frombuffer(text, np.uint8)
            for doc_id, end, size, all_, is_copy in zip(ids, ends.tolist(), sizes.tolist(), full.tolist(), copy.tolist()):
                if is_copy:
                    yield doc_id, np.zeros(all_, np.uint8), np.ones(all_, bool), True
                    continue
                mine = lost[end - size : end]
                yield doc_id, whole[end - size : end], mine, bool(mine.any())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        kinds = [pa.int64(), pa.int64(), pa.list_(span), pa.string(), pa.binary()]
        names = ["doc_id", "n_bytes", "removed", "kept_sha256", "kept"]
        width_ = 4 + with_text
        for b in batches:
            out = []
            for doc_id, text, mine, any_ in spans_of(b):
                kept = (text[~mine] if any_ else text).tobytes()
                step = np.diff(mine.astype(np.int8), prepend=0, append=0) if any_ else np.empty(0, np.int8)
                spans = [{"start": a, "end": z} for a, z in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist())]
                out.append((doc_id, len(text), spans, hashlib.sha256(kept).hexdigest(), kept))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds[:width_])], names[:width_])

    return rows.select("shard", "data", "copies", "places", "found").mapInArrow(work, RESULT + ", kept binary" * with_text)


def repeats(docs: DataFrame, *, width: int = 50, shard_bytes: int = 1 << 20, large: int = 10_000, with_text: bool = False, facts: dict | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, removed (spans of bytes), kept_sha256 and, if wanted, kept: the bytes that stay.

    large: distinct pieces (each shard counts 255 at most) beyond which an anchor's windows are dealt by their hashes.
    facts receives how many things that shards lose were found by piece, by merge and by window.
    """
    if width % 2 or not GRAM < width <= 4096:
        raise ValueError(f"width must be even, over {GRAM} and no more than 4096")
    spark = docs.sparkSession
    bound_batches(spark)
    buckets = max(partitions(spark), -(-scanned_bytes(docs) // BUCKET_BYTES))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    shards = save_by(packed(rows, width, shard_bytes), "bwt-shards", "shard", partitions(spark))
    gone = save(copies(shards), "bwt-copies")
    whole = shards.select("shard", "data").join(gone, "shard", "left")
    sent = save(anchors(whole, buckets, width), "bwt-anchors", "lz4")
    told = sent.groupBy("bucket").applyInArrow(shared_anchors(large), "shard long, bucket int, kinds binary")
    told = told.groupBy("shard").agg(F.collect_list(F.struct("bucket", "kinds")).alias("told"))
    held = save(pieces(whole.join(told, "shard", "left"), buckets, width), "bwt-pieces", "lz4")
    delete(spark, sent)
    found = save(held.where("bucket is not null").groupBy("bucket").applyInArrow(merged(width), FOUND), "bwt-runs", "lz4")
    if facts is not None:
        facts |= found.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("by_piece", "by_merge", "by_window")]).first().asDict()
    runs = found.groupBy("shard").agg(F.collect_list(F.struct("bucket", "runs")).alias("found"))
    places = held.where("bucket is null").select("shard", F.col("data").alias("places"))
    out = save(cut(whole.join(places, "shard", "left").join(runs, "shard", "left"), width, with_text), "bwt-result")
    delete(spark, shards, gone, held, found)
    return out


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """The digest for the query."""
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return repeats(docs, **options).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "kept_sha256")


REPEATS_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents), w AS (SELECT doc_id, i, b[i : i + 49] AS s FROM d, LATERAL (SELECT unnest(range(1, octet_length(b) - 48)) AS i)),
  g AS (SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, 0) AS new FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM w) WHERE first < doc_id),
  p AS (SELECT doc_id, min(i) AS lo, max(i) + 50 AS hi FROM (SELECT doc_id, i, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g) GROUP BY doc_id, k),
  c AS (SELECT doc_id, count(*) AS n_spans, sum(hi - lo) AS n_removed, list(lo ORDER BY lo) AS lo, list(hi ORDER BY lo) AS hi FROM p GROUP BY doc_id)
SELECT doc_id, octet_length(b) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(array_to_string(list_transform(range(0, coalesce(len(lo), 0) + 1), lambda k: hex(b[CASE WHEN k = 0 THEN 1 ELSE hi[k] END : CASE WHEN k = coalesce(len(lo), 0) THEN octet_length(b) ELSE lo[k + 1] - 1 END])), ''))) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)
"""
