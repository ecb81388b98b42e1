"""Mixing, packing, archives, neighbours, the language model and the pipeline, each against a plain version or a round trip."""

import base64
import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescry.llm import mixing, packing, quality, queries, vptree, warc

from . import brute

MIX = "doc_id long, text string, source string"


def mix_rows():
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)), rng.choice(["a", "a", "a", "b", "é", "z", None])) for i in range(600)]
    return rows + [(700, None, "a"), (701, "", "nul"), (702, "x " * 5000, "b"), (703, "q", "tiny"), (703, "q", "tiny"), (None, "one two", "b")]


def test_capped_targets():
    sizes = {"a": 100, "b": 10, "c": 10, "d": 0}
    got = mixing.capped_targets(sizes, {"a": 1, "b": 2, "c": 3, "d": 1}, 120, 3)
    assert got == {"a": 60.0, "b": 30.0, "c": 30.0, "d": 0.0}
    assert mixing.capped_targets({}, {}, 0, 3) == {}


def test_schedule_integral_and_inverse(spark):
    df = spark.createDataFrame([(i, "w " * 10, "s") for i in range(400)], MIX)
    plan = mixing.plan_mix(df, lambda n, s: [(0.0, 1.0), (1.0, 3.0)]).select(F.inline("takes"))
    at = sorted(r["position"] for r in plan.collect())
    # demand t + t^2 (of 2) has been met at the k-th document: invert by bisection
    for k, t in enumerate(at):
        assert math.isclose((t + t * t) / 2, k / 400, abs_tol=1e-9)


def test_mix(spark):
    rows = mix_rows()
    df = spark.createDataFrame(rows, MIX).withColumns({c: F.lit(1) for c in ("size", "target", "takes", "name", "slice", "before", "turn")})
    first, second = ({(r["doc_id"], r["size"], r["taken"], r["target"]) for r in mixing.mixed_documents(x).collect()} for x in (df, df.repartition(7)))
    assert first == second
    out = mixing.mixed_documents(df).collect()
    assert len(out) == len(rows)
    words = lambda t: len(brute.WORD.findall(t or ""))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += words(t)
    names = sorted(s for s in sizes if s is not None) + [None]
    targets = mixing.capped_targets(sizes, {s: 1 + n % 3 for n, s in enumerate(names)}, sum(sizes.values()), 3)
    by_target = Counter()
    for r in out:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by_target[round(r["target"], 6), r["source_size"]] += r["taken"]
    want = Counter()
    for s in names:
        want[round(targets[s], 6), sizes[s]] += round(targets[s])
    assert {k: v for k, v in by_target.items() if v} == {k: v for k, v in want.items() if v}
    assert mixing.mixed_documents(df.limit(0)).count() == 0


def test_mixed_texts(spark):
    rows = mix_rows()
    df = spark.createDataFrame(rows, MIX).withColumn("n_chars", F.char_length("text").cast("long"))
    plan = mixing.plan_mix(df, mixing.curriculum, identity=mixing.identity_of(df))
    taken = {(r["doc_id"]): r["taken"] for r in plan.groupBy("doc_id").agg(F.sum("taken").alias("taken")).collect()}
    got = Counter()
    out = mixing.mixed_texts(df, mixing.curriculum)
    assert out.columns == df.columns
    for r in out.collect():
        got[r["doc_id"]] += len(brute.WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert dict(got) == {d: t for d, t in taken.items() if t}


def test_mixed_rows_are_told_apart(spark):
    """Rows that agree in id and text but not in other columns stay what they are; a shortened use keeps its white space."""
    rows = [(1, "a b\n c", "s", "en"), (1, "a b\n c", "s", "de"), (1, "a b\n c", "s", "de"), (None, "x", "s", None), (None, "x", "s", "en")]
    df = spark.createDataFrame(rows, MIX + ", lang string").withColumn("m", F.create_map(F.lit("k"), "lang"))
    level = lambda n, s: [(0.0, 1.0)]
    once = mixing.mixed_texts(df, level)
    assert Counter((r["doc_id"], r["text"], r["lang"], r["m"]["k"]) for r in once.collect()) == Counter((d, t, x, x) for d, t, _, x in rows)
    half = mixing.mixed_texts(spark.createDataFrame([(1, " a b\n c\td  e ", "s")], MIX), level, share=0.6).collect()
    assert [r["text"] for r in half] == [" a b\n c"]
    with pytest.raises(ValueError):
        mixing.plan_mix(df.withColumn("source", F.col("lang")), level, most_sources=2)


def test_packing(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer()
    t = Tokenizer.from_file(path)
    texts = [(1, None), (2, ""), (3, "Hello, WORLD. it's <|endoftext|> fine<|endoftext|>x <|ENDOFTEXT|>"), (4, "naïve İstanbul ΣΑΣ é  x y\x1cz\x85 日本語。テスト"), (5, "word " * 9000), (6, "a.b, c.. d,, e., 12.5, x."), (6, "again"), (None, "nothing")]
    df = spark.createDataFrame(texts, brute_docs := "doc_id long, text string").withColumns({c: F.lit(1) for c in ("piece", "start", "length", "group", "room")})
    rows = packing.pieces(df, path, remembered=5).collect()
    want = Counter((d, *p) for d, x in texts for p in brute.pieces(t.encode(x or "", add_special_tokens=False).ids + [1]))
    assert Counter(tuple(r) for r in rows) == want
    whole = packing.pieces(df, path, with_ids=True)
    assert whole.where("doc_id = 3").first()["ids"] == t.encode(texts[2][1], add_special_tokens=False).ids + [1]
    packed = packing.packed_documents(df, path).collect()
    assert Counter(tuple(r)[:5] for r in packed) == want
    check_sequences(packed)
    assert packing.packed_documents(spark.createDataFrame([], brute_docs), path).count() == 0


def test_marks_after_capitals(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer()
    t = Tokenizer.from_file(path)
    texts = ["W\u030a", "T\u0308a x", "Hello H\u0331ello", "J\u030c", "Y\u030a É", "T\u0344", "T\u0316\u0308", "E\u0301 ABC e\u0301", "Éa ÉA"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in packing.pieces(df, path, with_ids=True).collect()}
    assert got == {i: t.encode(x, add_special_tokens=False).ids + [1] for i, x in enumerate(texts)}


def check_sequences(rows, capacity=4096):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for members in by.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pack_rounds(spark):
    rng = random.Random(3)
    rows = [(i, 0, 0, rng.randrange(1, 2500), i) for i in range(3000)]
    df = spark.createDataFrame(rows, packing.PIECES)
    out = packing.pack(df, group_rows=500).collect()
    assert len(out) == len(rows)
    assert check_sequences(out) <= -(-sum(r[3] for r in rows) // 4096) + 2


def test_local_search():
    # 6 + 4 and 5 + 5 fill two bins of 10; a bad start uses three
    lengths = [6, 5, 5, 4]
    out = packing.improve([[0], [1, 3], [2]], lengths, 10)
    assert len(out) == 2 and sorted(i for b in out for i in b) == [0, 1, 2, 3]
    # 7 + 3 by a swap, then 5 + 3 + 2 by a move
    assert len(packing.improve([[0, 1], [2, 3], [4]], [7, 2, 5, 3, 3], 10)) == 2
    # 1 + 4 + 4 takes 5 for 4, or two for one: 9 + 1, 6 + 4
    assert len(packing.improve([[0, 1], [2], [3]], [4, 5, 6, 5], 10)) == 2
    assert packing.improve([[0], [1]], [7, 8], 10) == [[0], [1]]
    rng = random.Random(1)
    for _ in range(20):
        lengths = [rng.randrange(1, 60) for _ in range(80)]
        start = [[i] for i in range(80)]
        bins = packing.improve([list(b) for b in start], lengths, 100)
        assert sorted(i for b in bins for i in b) == list(range(80)) and all(sum(lengths[i] for i in b) <= 100 for b in bins)
        assert len(bins) <= len(packing.best_fit(lengths, 100)) + 2
    assert packing.best_fit([], 10) == []


@pytest.mark.parametrize("low, high, n", [(900, 2500, 16_384), (1, 4096, 6000)])
def test_search_comes_near_the_bound(low, high, n):
    rng = random.Random(1)
    lengths = [rng.randint(low, high) for _ in range(n)]
    best = packing.best_fit(lengths, 4096)
    bins = packing.improve([list(b) for b in best], lengths, 4096)
    bound = -(-sum(lengths) // 4096)
    assert sorted(i for b in bins for i in b) == list(range(n)) and max(sum(lengths[i] for i in b) for b in bins) <= 4096
    assert len(bins) <= 1.01 * bound and len(bins) <= len(best)
    # a local optimum: what one more run finds is nothing
    assert len(packing.improve([list(b) for b in bins], lengths, 4096)) == len(bins)


def test_rounds_go_on_until_nothing_is_saved(spark):
    """Pieces that can't share a sequence end it at once, whatever the number of groups."""
    df = spark.range(3000).select("id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(2100).cast("long").alias("length"), F.col("id").alias("ids_crc32")).withColumnRenamed("id", "doc_id")
    assert check_sequences(packing.pack(df, group_rows=100).collect()) == 3000
    mixed = df.withColumn("length", F.when(F.col("doc_id") % 3 == 0, 4000).otherwise(F.col("doc_id") % 97 + 1).cast("long"))
    out = packing.pack(mixed, group_rows=100)
    assert check_sequences(out.collect()) <= -(-out.agg(F.sum("length")).first()[0] // 4096) + 30


PAGES = "page_id long, url string, html string"


def test_warc(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    extra = spark.createDataFrame([(9001, "u\r\nWARC-Type: x", "aa"), (9002, None, "aa"), (None, "u", "aa"), (9004, "é", None), (9005, "v", ""), (9001, "u", "aa"), (9006, "big", "x" * 3_000_000)], PAGES)
    df = pages.unionByName(extra).withColumns({c: F.lit("x") for c in ("payload", "digest", "bundle", "frame", "offset", "alone", "its_id", "record_id", "refers_to")})
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in df.collect()]
    least = {}
    for d, h in rows:
        if d is not None:
            least[h] = min(d, least.get(h, d))
    want = Counter((d, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "response" if d == least[h] else "revisit", None if d == least[h] else least[h]) for d, h in rows)
    assert Counter(tuple(r) for r in warc.archived_pages(df).collect()) == want
    assert warc.archived_pages(df.limit(0)).count() == 0


def test_seekable_bundle(spark, tmp_path):
    import zstandard

    folder = f"file://{tmp_path}"
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>" * 200) for i in range(50)], PAGES).coalesce(1)
    index = warc.write_bundles(warc.with_revisits(pages), folder, frame_bytes=4000, bundle_bytes=6000)
    names = [p.name for p in tmp_path.glob("*.warc.zst")]
    assert len(names) > 1
    for name in names:
        data = (tmp_path / name).read_bytes()
        table = warc.read_seek_table(data)
        plain = b"".join(zstandard.ZstdDecompressor().decompress(data[sum(c for c, _ in table[:i]) :][: table[i][0]], max_output_size=table[i][1]) for i in range(len(table)))
        assert zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read() == plain
        for r in index.where(F.col("bundle") == name).collect():
            base = sum(p for _, p in table[: r["frame"]])
            assert plain[base + r["offset"] :].startswith(b"WARC/1.1\r\n") and r["at"] == sum(c for c, _ in table[: r["frame"]])
    one = index.limit(1)
    assert warc.read_records(one, folder).first()["record_type"] == "response"
    small = warc.with_revisits(spark.createDataFrame([(1, "u", "a"), (2, "u", "a")], PAGES), min_bytes=5)
    assert small.where("refers_to is not null").count() == 0


def test_warc_lookup(spark, tmp_path):
    """Single records by page id or record id, one frame each; repeated rows have identifiers of their own."""
    folder = f"file://{tmp_path}"
    rows = [(i, f"http://h/{i}", f"<p>{i % 40}</p>" * 200) for i in range(50)] + [(3, "http://h/3", "<p>3</p>" * 200), (None, "u", "n"), (None, "u", "n"), (7, "http://h/7", "other")]
    index = warc.write_bundles(warc.with_revisits(spark.createDataFrame(rows, PAGES).repartition(2)), folder, frame_bytes=4000)
    assert index.count() == len(rows) == index.select("record_id").distinct().count()
    assert index.select("bundle", "frame").distinct().count() > 10
    for page in (5, 45):
        frames = spark.sparkContext.accumulator(0)
        got = warc.lookup(index, folder, spark.createDataFrame([(page,)], "page_id long"), frames_read=frames).collect()
        assert [(r["page_id"], r["record_type"], r["refers_to"]) for r in got] == [(page, *(("response", None) if page < 40 else ("revisit", page - 40)))]
        assert frames.value == 1
    name = index.where("page_id = 45").first()["record_id"]
    frames = spark.sparkContext.accumulator(0)
    assert [r["page_id"] for r in warc.lookup(index, folder, index.where(F.col("record_id") == name), by="record_id", frames_read=frames).collect()] == [45] and frames.value == 1
    assert warc.lookup(index, folder, spark.createDataFrame([(99,)], "page_id long")).count() == 0
    # what a revisit refers to is the identifier of a record
    told = index.where("page_id = 5").first()["record_id"]
    raw = warc.warc_record(name, "u", b"", told.rpartition(":")[2], 5, "d")
    assert f"WARC-Refers-To: <{told}>".encode() in raw


def brute_nearest(ids, x, queries_, k):
    out = {}
    for q, v in queries_:
        s = [(-(float((w * v).sum())), i) for i, w in zip(ids, x) if i != q]
        out[q] = [(i, -d) for d, i in sorted(s)[:k]]
    return out


VECTORS = "vec_id long, embedding array<float>"


def test_exact_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 12)) * rng.uniform(0.2, 3, size=(700, 1))
    x[300:360] = x[7]  # a very common vector
    rows = [(i, [float(v) for v in np.float32(w)]) for i, w in enumerate(x)]
    bad = [(1000, None), (1020, [0.0] * 12), (1040, [float("nan")] + [1.0] * 11), (1060, [float("inf")] + [1.0] * 11), (1100, [None] + [1.0] * 11), (1120, [])]
    df = spark.createDataFrame(rows + bad, VECTORS).withColumns({c: F.lit(1) for c in ("part", "data", "score", "rank", "v")})
    asked = df.where(F.col("vec_id") % 20 == 0)
    ids, y = np.arange(700), np.float32(x).astype(float)
    want = brute_nearest(ids, y, [(i, y[i]) for i in range(0, 700, 20)], 9)
    got = defaultdict(list)
    for r in vptree.nearest(df, asked, k=9, factor=1.0, shard_rows=200, block_rows=10).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=0, atol=1e-12)


def test_neighbours_recall_and_edges(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    x = df.toPandas()
    m = np.stack(x.embedding).astype(float)
    ids = x.vec_id.to_numpy()
    want = brute_nearest(ids, m, [(i, v) for i, v in zip(ids, m) if i % 20 == 0], 20)
    got = defaultdict(set)
    for r in vptree.neighbours(df).collect():
        got[r["query_id"]].add(r["vec_id"])
    assert np.mean([len(got[q] & {i for i, _ in v}) / 20 for q, v in want.items()]) >= 0.9
    assert vptree.neighbours(df.limit(0)).count() == 0
    # other lengths are searched among their own, and an index is made once for many searches
    lengths = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (20, [1.0, 1.0, 1.0]), (21, [0.0, 0.0, 2.0]), (40, [1.0])], VECTORS)
    index = vptree.build(lengths)
    for _ in range(2):
        assert sorted(tuple(r) for r in vptree.search(index, lengths.where("vec_id % 20 = 0")).collect()) == [(0, 1, 1, 2.0), (20, 1, 21, 2.0)]
    wide = spark.createDataFrame([(0, [1e200, -1e200]), (1, [1e190, 0.0]), (2, [-1e180, 1e-300]), (3, [1e-320, 0.0])], "vec_id long, embedding array<double>")
    assert [(r["rank"], r["vec_id"]) for r in vptree.neighbours(wide).orderBy("rank").collect()] == [(1, 1), (2, 3), (3, 2)]
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [1.0, 0.0])], VECTORS)
    assert [(r["rank"], r["vec_id"], r["score"]) for r in vptree.neighbours(few).orderBy("rank").collect()] == [(1, 2, 1.0), (2, 1, 0.5)]


class PlainModel:
    """Interpolated modified Kneser-Ney, from the definition."""

    def __init__(self, texts, order=quality.ORDER):
        grams = Counter(tuple(b) for t in texts for b in self.windows(t, order))
        self.order, self.levels = order, {order: grams}
        for n in range(order - 1, 0, -1):
            self.levels[n] = Counter(g[1:] for g in self.levels[n + 1])
        self.parts = {}
        for n, c in self.levels.items():
            k = [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
            y = k[0] / (k[0] + 2 * k[1]) if k[0] else 0.0
            d = [0.0] + [max(0.0, min(float(i), i - (i + 1) * y * k[i] / k[i - 1])) if k[i - 1] else 0.5 * y for i in (1, 2, 3)]
            total, freed = Counter(), Counter()
            for g, v in c.items():
                total[g[:-1]] += v
                freed[g[:-1]] += d[min(v, 3)]
            self.parts[n] = (d, total, freed)

    @staticmethod
    def windows(text, order):
        b = bytes(order - 1) + text.encode()
        return [b[i : i + order] for i in range(len(b) - order + 1)]

    def p(self, gram):
        out = 1 / 256
        for n in range(1, self.order + 1):
            g = tuple(gram[-n:])
            d, total, freed = self.parts[n]
            if total[g[:-1]]:
                c = self.levels[n][g]
                out = (c - d[min(c, 3)] + freed[g[:-1]] * out) / total[g[:-1]]
        return out

    def perplexity(self, text):
        w = self.windows(text, self.order)
        return math.exp(-sum(math.log(self.p(g)) for g in w) / len(w)) if w else 1.0


def test_language_model(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").limit(60), spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = [r["doc_id"] for r in labels.where("quality = 1 and toxic = 0").collect() if r["doc_id"] in rows]
    held = quality.held_out(np.array(good))
    model = PlainModel([rows[d] for d, h in zip(good, held) if not h])
    busy = docs.withColumns({c: F.lit(1) for c in ("shard", "ids", "data", "held", "gram", "trusted")})
    out = quality.perplexities(busy, labels, shard_bytes=20_000).collect()
    assert len(out) == len(rows)
    for r in out[:15]:
        assert math.isclose(r["perplexity"], model.perplexity(rows[r["doc_id"]]), rel_tol=1e-3)
    assert {r["doc_id"] for r in out if r["held"]} == {d for d, h in zip(good, held) if h}


def test_probabilities_sum_to_one(spark):
    texts = ["abracadabra", "abrabra cad", "banana band"]
    model = PlainModel(texts)
    for context in (b"\0\0\0a", b"abra", b"zzzz", b"\0\0\0\0"):
        assert math.isclose(sum(model.p(context + bytes([b])) for b in range(256)), 1, abs_tol=1e-9)


def test_classifier(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = quality.classify(docs, labels).join(labels, "doc_id")
    r = out.agg(F.avg(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), F.col("kept").cast("int"))).alias("good"), F.avg(F.when((F.col("quality") == 0) & (F.col("toxic") == 0), F.col("kept").cast("int"))).alias("bad")).first()
    assert r["good"] > 0.98 and r["bad"] < 0.2


@pytest.fixture(scope="module")
def judged(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    return quality.classify(docs, labels).join(labels, "doc_id", "left").toPandas()


def test_limits_are_quantiles(judged):
    good = judged[(judged.quality == 1) & (judged.toxic == 0)]
    held = good[quality.held_out(good.doc_id.to_numpy()) & (good.n_bytes > 0)]
    for lang, rows in judged[judged.n_bytes > 0].groupby("lang"):
        limit = np.quantile(held.perplexity[held.lang == lang], 0.99, method="inverted_cdf")
        assert np.allclose(rows.threshold, limit * np.exp(2 / np.sqrt(rows.n_bytes)))
        assert not rows.kept[(rows.quality == 0) & (rows.perplexity > 10)].any()


def test_repetition():
    text = b"a b c d a b c e f a b c"
    words = text.split()
    grams = list(zip(words, words[1:], words[2:]))
    want = 1 - len(set(grams)) / len(grams)
    assert 0 < want < 1
    for block in (1, 3, 7, 1 << 20):
        assert math.isclose(quality.repeated(text.replace(b" ", b"\n\t "), block), want)
    assert quality.repeated(b"") == quality.repeated(b"a a") == quality.repeated(b"a b c d") == 0
    assert quality.repeated(b"Der " * 100) == 1 - 1 / 98


def test_repeating_junk_is_rejected(judged):
    clean = judged[judged.toxic == 0]
    for lang, rows in clean.groupby("lang"):
        assert rows.kept[rows.quality == 1].mean() > 0.98, lang
        assert rows.kept[rows.quality == 0].mean() < 0.05, lang
    assert not judged.kept[judged.repeated > 0.5].any()


def test_thresholds_and_verdicts(spark, sf):
    """Every column of the query against a plain version, for the first documents and all labels."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r["doc_id"]: (r["text"] or "", r["lang"]) for r in docs.collect()}
    good = [r["doc_id"] for r in labels.where("quality = 1 and toxic = 0").collect() if r["doc_id"] in rows]
    held = {d for d, h in zip(good, quality.held_out(np.array(good))) if h}
    model = PlainModel([rows[d][0] for d in good if d not in held])
    cut = {d: t if len(t) <= 3000 else None for d, (t, _) in rows.items()}
    out = {r["doc_id"]: r for r in quality.classify(docs, labels, enough=2).collect()}
    assert out.keys() == rows.keys()
    exact = {d: model.perplexity(t) if t is not None else out[d]["perplexity"] for d, t in cut.items()}
    again = {}
    for d, (t, _) in rows.items():
        w = t.encode().split()
        grams = list(zip(w, w[1:], w[2:]))
        again[d] = 1 - len(set(grams)) / len(grams) if grams else 0.0
    quantile = lambda v: sorted(v)[math.ceil(0.99 * len(v)) - 1]
    for d, (t, lang) in rows.items():
        peers = [h for h in held if rows[h][0] and rows[h][1] == lang]
        peers = peers if len(peers) >= 2 else [h for h in held if rows[h][0]]
        room = math.exp(2 / math.sqrt(max(1, len(t.encode()))))
        limit, most = quantile([exact[h] for h in peers]) * room, max(0.3, quantile([again[h] for h in peers])) * room
        r = out[d]
        assert math.isclose(r["perplexity"], exact[d], rel_tol=1e-3) and math.isclose(r["threshold"], limit, rel_tol=1e-3)
        assert math.isclose(r["repeated"], again[d], abs_tol=1e-12) and math.isclose(r["repeated_threshold"], most, rel_tol=1e-12)
        if not math.isclose(exact[d], limit, rel_tol=2e-3):
            assert r["kept"] == (exact[d] <= limit and again[d] <= most)


def test_classifier_edges(spark):
    schema = "doc_id long, text string, lang string"
    labels = "doc_id long, quality int, toxic int"
    df = spark.createDataFrame([(1, None, None), (2, "", "en"), (None, "abc", "en"), (4, "hello world", None), (4, "hello", "de"), (5, "x" * 100_000, "en")], schema)
    for known in ([(4, 1, 0), (5, 0, None)], []):
        out = quality.classify(df, spark.createDataFrame(known, labels)).collect()
        assert len(out) == 6 and all(r["kept"] for r in out)
        assert {r["perplexity"] for r in out if not r["n_bytes"]} == {1.0}
    assert quality.classify(df.limit(0), spark.createDataFrame([], labels)).count() == 0


@pytest.fixture(scope="module")
def staged(spark, sf, tmp_path_factory):
    import corpus_pipeline

    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        out.append(docs)
    return out


def test_pipeline(spark, sf, staged):
    docs, kept, lines, unique, mixed, packed = staged
    assert all(d.columns == docs.columns for d in (kept, lines, unique, mixed))
    rows = lambda d: [(r["doc_id"], r["text"]) for r in d.collect()]
    assert {d for d, _ in rows(kept)} <= {d for d, _ in rows(docs)}
    want = {d: s for d, _, _, s in brute.lines(rows(kept))}
    assert {d: brute.sha(t or "") for d, t in rows(lines)} == want
    near = brute.near(rows(lines))
    assert {d for d, _ in rows(unique)} == {d for d, (_, c) in near.items() if d == c}
    assert {d for d, _ in rows(mixed)} <= {d for d, _ in rows(unique)}
    check_sequences(packed.collect())
    assert {r["doc_id"] for r in packed.collect()} == {d for d, _ in rows(mixed)}


#: Names that the stages and operators use inside.
INSIDE = "row id ids text_ turn _turn use_id name n size takes target pass words position before slice pieces whole no_source wanted _wanted _id _use _text _lines _drop _kept_text kept_text n_lines n_dropped print other_id other_print drop line pos a b docs last shard data prints bucket lang_ held trusted perplexity threshold repeated kept component_id x y rep root tree p1 group piece start length room offset sequence_id ids_crc32 _limit _again _n _lang".split()


def test_pipeline_keeps_clashing_columns(spark, sf, tmp_path):
    """Extra columns with the names used inside come through every stage with their values."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 80").withColumns({c: F.col("doc_id") * 10 + i for i, c in enumerate(INSIDE)})
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if i == len(corpus_pipeline.STAGES) - 1:
            assert out.count() > 0
            break
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        wrong = F.lit(False)
        for j, c in enumerate(INSIDE):
            wrong = wrong | (F.col(c) != F.col("doc_id") * 10 + j)
        assert docs.count() > 0 and docs.where(wrong).count() == 0


def test_pipeline_takes_odd_rows(spark, tmp_path):
    import corpus_pipeline

    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "abc def", "en", None, 7), (4, "hello world", None, "s", 11), (4, "hello world", None, "s", 11)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for some in (rows, []):
        docs = spark.createDataFrame(some, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
        assert docs.count() >= 0
