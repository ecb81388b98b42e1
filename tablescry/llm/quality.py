"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is of bytes, of order five, so an n-gram is its own exact key. Trusted
documents are labelled ones of good quality that aren't toxic; a fifth of them, by
hash, are held out. Documents are packed in shards, a table bucketed by shard number:

1. each shard sends the counts of its trusted n-grams and the distinct n-grams that it
   needs, dealt over buckets by hash;
2. counts are summed, lower orders get continuation counts, discounts come from the
   counts of counts of each order, and joins from the lowest order up give the
   interpolated probability of every n-gram that is needed;
3. each shard gets its n-grams' probabilities back and adds them up by document.

A document is rejected when its perplexity exceeds its language's limit, a quantile of
the held-out documents. A short text's mean is noisy: the limit is raised by a factor
exp(noise / sqrt(bytes)). Five bytes don't show that a text repeats itself, so a document
is rejected too when the share of its word trigrams that occurred in it before exceeds a
limit: the same quantile, but no less than `repeats`, raised in the same way.

All text is counted and scored; the model and what the shards ask for grow with the
corpus. Defined results: a null or empty text has perplexity 1 and is kept; languages
with fewer than `enough` held-out documents use the quantile of all; without any,
nothing is rejected; a text of less than three words repeats nothing; a null language is a language; rows that share an id are all
trusted if one is; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, delete, few_files, partitions, save, save_by, text_of
from .suffix_dedup import pack, stirred, unpack

ORDER = 5
#: Probabilities travel as 1/2000 nats in 16 bits.
STEPS = 2000
SCORE = "doc_id long, lang string, n_bytes long, log_p double, repeated double, held boolean"


def blocks(text: bytes, sizes: np.ndarray, block: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, n-gram) of each byte: it and the four before it in its document, zeros before the start."""
    whole = np.frombuffer(text, np.uint8)
    ends = np.cumsum(sizes)
    for lo in range(0, len(whole), block):
        hi = min(len(whole), lo + block)
        first, last = np.searchsorted(ends, lo, "right"), np.searchsorted(ends, hi - 1, "right")
        begin = np.concatenate([[0], ends])[first : last + 1]
        doc = np.repeat(np.arange(first, last + 1), np.minimum(ends[first : last + 1], hi) - np.maximum(begin, lo))
        offset = np.arange(lo, hi) - begin[doc - first]
        reach = min(lo, ORDER - 1)
        here = np.concatenate([np.zeros(ORDER - 1 - reach, np.uint8), whole[lo - reach : hi]]).astype(np.uint64)
        gram = here[ORDER - 1 :].copy()
        for back in range(1, ORDER):
            gram |= np.where(offset >= back, here[ORDER - 1 - back : len(here) - back], np.uint64(0)) << np.uint64(8 * back)
        yield doc, gram


class Grams:
    """A set of n-grams that finds the place of each in sorted order: a direct table first, a search for what collides there."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = np.uint64(64 - max(12, int(8 * len(keys)).bit_length()))
        self.slots = np.full(1 << (64 - int(self.shift)), np.iinfo(np.uint64).max, np.uint64)
        self.place = np.zeros(len(self.slots), np.int32)
        at = self._slot(keys)
        self.slots[at] = keys
        self.place[at] = np.arange(len(keys))

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        return grams * np.uint64(0x9E3779B97F4A7C15) >> self.shift

    def find(self, grams: np.ndarray) -> np.ndarray:
        at = self._slot(grams)
        out = self.place[at]
        miss = np.flatnonzero(self.slots[at] != grams)
        if len(miss):
            rest = grams[miss]
            i = np.searchsorted(self.keys, rest)
            i[i == len(self.keys)] = 0
            out[miss] = np.where(self.keys[i] == rest, i, -1) if len(self.keys) else -1
        return out


def repeated(text: bytes, block: int = 1 << 20) -> float:
    """The share of word trigrams that occurred before in the text. Words are split a block at a time."""
    space, at, parts = re.compile(rb"\s"), 0, [np.empty(0, np.int64)]
    while at < len(text):
        end = space.search(text, at + block)
        stop = end.start() if end else len(text)
        words = text[at:stop].split()
        parts.append(np.fromiter(map(hash, words), np.int64, len(words)))
        at = stop
    word = np.concatenate(parts).astype(np.uint64)
    if len(word) < 3:
        return 0.0
    factor = np.uint64(0x9E3779B97F4A7C15)
    gram = np.sort((word[:-2] * factor + word[1:-1]) * factor + word[2:])
    return np.count_nonzero(gram[1:] == gram[:-1]) / len(gram)


def bucket_of(grams: np.ndarray, buckets: int) -> np.ndarray:
    """By the first three bytes: n-grams that begin alike travel together, as small steps."""
    return (stirred(grams >> np.uint64(16)) >> np.uint64(32)) % np.uint64(buckets)


def held_out(ids: np.ndarray) -> np.ndarray:
    return stirred(ids.astype(np.uint64)) % np.uint64(5) == 0


def packed(docs: DataFrame, shard_bytes: int) -> DataFrame:
    """shard, ids, data (ids, languages, sizes, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, ids, langs, texts, held = TaskContext.get().partitionId() << 32, [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal number, ids, langs, texts, held
            row = pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([pack(ids, langs, np.fromiter(map(len, texts), np.int64, len(texts)), b"".join(texts), level=3)], pa.binary())],
                ["shard", "ids", "data"],
            )
            number, ids, langs, texts, held = number + 1, [], [], [], 0
            return row

        for b in batches:
            for doc_id, lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                ids.append(doc_id)
                langs.append(lang)
                texts.append(text.as_buffer().to_pybytes())
                held += len(texts[-1])
                if held >= shard_bytes:
                    yield close()
        if ids:
            yield close()

    return docs.mapInArrow(work, "shard long, ids array<long>, data binary")


def trained(ids: list, trusted: list) -> tuple[np.ndarray, np.ndarray]:
    """For each document: is it trusted, and is it held out?"""
    known = np.array([i is not None for i in ids], bool)
    order = np.array([i or 0 for i in ids], np.int64)
    return known & np.isin(order, np.array(trusted or [], np.int64)), held_out(order)


def sent(rows: DataFrame, buckets: int) -> DataFrame:
    """shard, bucket, asked (distinct n-grams), seen and counts (trusted ones). rows: shard, data, trusted."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for shard, data, trusted in zip(b.column("shard").to_pylist(), b.column("data"), b.column("trusted").to_pylist()):
                ids, _, sizes, text = unpack(data.as_buffer())
                good, held = trained(ids, trusted)
                learn = good & ~held
                known = Grams(np.empty(0, np.uint64))
                for _, gram in blocks(text, sizes):
                    new = gram[known.find(gram) < 0]
                    if len(new):
                        known = Grams(np.union1d(known.keys, new))
                counts = np.zeros(len(known.keys), np.int64)
                for doc, gram in blocks(text, sizes):
                    mine = learn[doc]
                    if mine.any():
                        counts += np.bincount(known.find(gram[mine]), minlength=len(counts))
                to = bucket_of(known.keys, buckets)
                by = np.argsort(to, kind="stable")
                cuts = np.searchsorted(to[by], np.arange(buckets + 1, dtype=np.uint64))
                for k in range(buckets):
                    if cuts[k] < cuts[k + 1]:
                        part = by[cuts[k] : cuts[k + 1]]
                        out.append((shard, k, pack(planes(np.diff(known.keys[part], prepend=np.uint64(0))), planes(counts[part].astype(np.uint32)))))
            kinds = (pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["shard", "bucket", "data"])

    return rows.select("shard", "data", "trusted").mapInArrow(work, "shard long, bucket int, data binary")


def planes(values: np.ndarray) -> bytes:
    """First bytes of all values, then second ones and so on: small values leave runs of zeros that compress away."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def unplaned(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


def opened(data: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    steps, counts = unpack(data.as_buffer())
    return np.cumsum(unplaned(steps, np.uint64), dtype=np.uint64), unplaned(counts, np.uint32)


def summed(table: pa.Table) -> pa.Table:
    """Of one bucket: every n-gram asked for, with its count in trusted text."""
    parts = [opened(d) for d in table.column("data")]
    gram, place = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    counts = np.bincount(place.reshape(-1), np.concatenate([c for _, c in parts]), len(gram)).astype(np.int64)
    return pa.table({"bucket": pa.array(np.full(len(gram), table.column("bucket")[0].as_py()), pa.int32()), "gram": pa.array(gram.astype(np.int64)), "count": pa.array(counts)})


def answered(asked: pa.Table, known: pa.Table) -> pa.Table:
    """Of one bucket: for each shard, the probabilities of its n-grams in the order asked."""
    gram = known.column("gram").to_numpy().astype(np.uint64)
    cost = np.minimum(np.rint(-np.log(known.column("p").to_numpy()) * STEPS), 65535).astype(np.uint16)
    by = np.argsort(gram)
    gram, cost = gram[by], cost[by]
    out = []
    for d in asked.column("data"):
        g, _ = opened(d)
        out.append(pack(planes(np.diff(g, prepend=np.uint64(0))), planes(cost[np.searchsorted(gram, g)])))
    return pa.table({"shard": asked.column("shard"), "costs": pa.array(out, pa.binary())})


def scored(rows: DataFrame) -> DataFrame:
    """Log-probability and repetition of each document. rows: shard, data, trusted, answers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, trusted, answers in zip(b.column("data"), b.column("trusted").to_pylist(), b.column("answers")):
                ids, langs, sizes, text = unpack(data.as_buffer())
                good, held = trained(ids, trusted)
                total = np.zeros(len(ids))
                if answers.is_valid:
                    told = [unpack(a.as_buffer()) for a in answers.values]
                    gram = np.concatenate([np.cumsum(unplaned(g, np.uint64), dtype=np.uint64) for g, _ in told])
                    cost = np.concatenate([unplaned(c, np.uint16) for _, c in told])
                    by = np.argsort(gram)
                    known, cost = Grams(gram[by]), cost[by].astype(np.float64)
                    for doc, g in blocks(text, sizes):
                        total += np.bincount(doc, cost[known.find(g)], len(ids))
                ends = np.cumsum(sizes)
                again = [repeated(text[end - size : end]) for size, end in zip(sizes, ends)]
                columns = [ids, langs, sizes, -total / STEPS, again, good & held]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()))], ["doc_id", "lang", "n_bytes", "log_p", "repeated", "held"])

    return rows.select("shard", "data", "trusted", "answers").mapInArrow(work, SCORE)


def probabilities(grams: DataFrame) -> DataFrame:
    """gram, p: interpolated modified Kneser-Ney, joined up from the lowest order. grams: bucket, gram, count (0: not seen)."""
    spark = grams.sparkSession
    masked = lambda n: F.col("gram").bitwiseAND(F.lit((1 << 8 * n) - 1))
    level = save(grams.where("count > 0").select(F.lit(ORDER).alias("n"), "gram", "count"), "grams")
    levels = [level]
    for n in range(ORDER - 1, 0, -1):  # how many bytes come before it: each longer n-gram that ends in it counts once
        level = save(level.groupBy(masked(n).alias("gram")).agg(F.count("*").alias("count")).select(F.lit(n).alias("n"), "gram", "count"), "grams")
        levels.append(level)
    seen = levels[0]
    for x in levels[1:]:
        seen = seen.unionByName(x)
    counted = {r["n"]: r for r in seen.groupBy("n").agg(*[F.count_if(F.col("count") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]).collect()}
    p, made = None, []
    for n in range(1, ORDER + 1):
        k = counted.get(n)
        n1, n2, n3, n4 = (k["n1"], k["n2"], k["n3"], k["n4"]) if k else (0, 0, 0, 0)
        y = n1 / (n1 + 2 * n2) if n1 else 0.0
        d1, d2, d3 = (max(0.0, min(float(i), i - (i + 1) * y * b / a)) if a else 0.5 * y for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))
        discount = F.when(F.col("count") == 1, d1).when(F.col("count") == 2, d2).otherwise(d3)
        mine = levels[ORDER - n].select("gram", F.col("count"), discount.alias("discount"))
        context = mine.groupBy(F.shiftrightunsigned("gram", 8).alias("context")).agg(F.sum("count").alias("total"), F.sum("discount").alias("freed"))
        needed = grams.select("bucket", "gram") if n == ORDER else grams.select(masked(n).alias("gram")).distinct()
        x = needed.join(mine, "gram", "left").withColumn("context", F.shiftrightunsigned("gram", 8)).join(context, "context", "left")
        if p is None:
            x = x.withColumn("lower", F.lit(1 / 256))
        else:
            x = x.withColumn("short", masked(n - 1)).join(p.select(F.col("gram").alias("short"), F.col("p").alias("lower")), "short")
        share = (F.coalesce(F.col("count") - F.col("discount"), F.lit(0.0)) + F.col("freed") * F.col("lower")) / F.col("total")
        p = save(x.select(*needed.columns, F.greatest(F.coalesce(share, F.col("lower")), F.lit(1e-14)).alias("p")), "p")
        made.append(p)
    delete(spark, *levels, *made[:-1])
    return p


def perplexities(docs: DataFrame, labels: DataFrame, *, shard_bytes: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, repeated, held (trusted, but not trained on)."""
    spark = docs.sparkSession
    bound_batches(spark)
    buckets = partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), text_of(text_col).alias("text"))
    shards = save_by(few_files(packed(rows, shard_bytes)), "lm-shards", "shard", buckets)
    trusted = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    members = shards.select("shard", F.explode("ids").alias("doc_id")).join(trusted, "doc_id").groupBy("shard").agg(F.collect_list("doc_id").alias("trusted"))
    members = save(members, "lm-trusted")
    whole = shards.select("shard", "data").join(members, "shard", "left")
    asked = save(sent(whole, buckets), "lm-asked", "lz4")
    grams = save(asked.groupBy("bucket").applyInArrow(summed, "bucket int, gram long, count long"), "lm-grams")
    p = probabilities(grams)
    answers = asked.groupBy("bucket").cogroup(p.groupBy("bucket")).applyInArrow(answered, "shard long, costs binary")
    answers = save(answers, "lm-answers", "lz4").groupBy("shard").agg(F.collect_list("costs").alias("answers"))
    mean = F.when(F.col("n_bytes") > 0, F.col("log_p") / F.col("n_bytes")).otherwise(0.0)
    out = save(scored(whole.join(answers, "shard", "left")).select("doc_id", "lang", "n_bytes", F.exp(-mean).alias("perplexity"), "repeated", "held"), "lm-scores")
    delete(spark, shards, members, asked, grams, p)
    return out


def classify(docs: DataFrame, labels: DataFrame, *, high: float = 0.99, noise: float = 2.0, repeats: float = 0.3, enough: int = 10, accuracy: int = 100_000, **columns) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, threshold, repeated, repeated_threshold, kept.

    The quantiles come from summaries of bounded size, whose rank is off by one in
    `accuracy` at most: up to that many held-out documents a language they are exact.
    """
    scores = perplexities(docs, labels, **columns)
    held = scores.where("held and n_bytes > 0")
    quantile = lambda c: F.percentile_approx(c, high, accuracy)
    limits = [quantile("perplexity").alias("_limit"), F.greatest(quantile("repeated"), F.lit(repeats)).alias("_again")]
    all_ = held.agg(F.count("*").alias("_n"), *limits).first()
    each = held.groupBy(F.col("lang").alias("_lang")).agg(F.count("*").alias("_n"), *limits).where(F.col("_n") >= enough)
    rows = scores.join(each, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    room = F.exp(noise / F.sqrt(F.greatest("n_bytes", F.lit(1))))
    threshold, again = (F.coalesce(c, F.lit(all_[c] if all_["_n"] else None).cast("double")) * room for c in ("_limit", "_again"))
    kept = F.coalesce((F.col("perplexity") <= threshold) & (F.col("repeated") <= again), F.lit(True))
    return rows.select("doc_id", "lang", "n_bytes", "perplexity", threshold.alias("threshold"), "repeated", again.alias("repeated_threshold"), kept.alias("kept"))
