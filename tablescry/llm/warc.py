"""WARC records in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each holding a group of WARC/1.1
records, and a skippable frame at the end with a seek table (the public seekable
format: compressed and plain size of every frame). The index maps each record identifier
and page id to a bundle, a frame and an offset inside that frame, so one record costs one
frame to read: lookup() fetches records by either.

Records with equal payloads are stored once: the one with the smallest id is a
response, the others are revisits that name it.

Defined results: a null payload is empty; a null id is larger than all others and
can't be referred to; rows that share the smallest id are all responses; a record is
identified by its page id and payload digest, and where rows agree in both or have no id by a random
suffix too; a null or unprintable URL is written in escaped form; an empty table gives no bundle; other
columns of the input are ignored. A bundle's name holds a random part and counts
only if a committed index row names it, so lost or repeated tasks leave no trace in
the results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, new_path, save, text_of

SEEK_TABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "page_id long, record_id string, bundle string, frame int, at long, packed long, offset long, length long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame for frames of (compressed, plain) size."""
    import struct

    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SEEK_TABLE, len(body)) + body


def read_seek_table(tail: bytes) -> list[tuple[int, int]]:
    """The (compressed, plain) sizes, from the end of a bundle or all of it."""
    import struct

    n, flags, magic = struct.unpack("<IBI", tail[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end of the bundle")
    each = 8 + 4 * (flags >> 7)
    start = len(tail) - 9 - n * each
    return [struct.unpack_from("<II", tail, start + i * each) for i in range(n)]


def record_name(page_id: int | None, digest: str, alone: bool = True) -> str:
    """The identifier of a record; that of the response it revisits has the same form."""
    import uuid

    name = f"urn:page:{'' if page_id is None else page_id}:{digest}"
    return name if alone and page_id is not None else f"{name}:{uuid.uuid4().hex}"


def warc_record(name: str, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    from urllib.parse import quote

    uri = quote(url or "urn:none", safe=":/?#[]@!$&'()*+,;=%~-._")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name}>",
        f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[5:5] = [f"WARC-Refers-To: <{record_name(refers_to, digest)}>", f"WARC-Profile: {IDENTICAL}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields of one record; of a response, size and digest come from the payload itself."""
    import base64
    import hashlib

    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    told = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    page = lambda name: int(x) if (x := fields.get(name, "<urn:page:").removeprefix("<urn:page:").partition(":")[0]) else None
    out = {"page_id": page("WARC-Record-ID"), "record_type": fields["WARC-Type"], "refers_to": page("WARC-Refers-To"), "url": fields["WARC-Target-URI"], "payload": payload}
    if out["record_type"] == "revisit":
        size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        return out | {"payload_bytes": size, "payload_digest": told}
    if (digest := base64.b32encode(hashlib.sha1(payload).digest()).decode()) != told:
        raise ValueError(f"record {out['page_id']}: its payload has another digest than its header")
    return out | {"payload_bytes": len(payload), "payload_digest": digest}


def with_revisits(pages: DataFrame, *, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """page_id, url, payload, digest (hex), refers_to, alone (no other row agrees in id and payload)."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_of(payload_col).alias("payload")).withColumn("digest", F.sha1(F.encode("payload", "UTF-8")))
    key = ["digest", "bytes"]
    pairs = save(rows.groupBy("page_id", "digest", F.octet_length("payload").alias("bytes")).agg(F.count("*").alias("n")), "warc-pairs")
    large = pairs.where(F.col("bytes") >= min_bytes)
    # Written first: a join of two exchanges, not one of an aggregate in place, can split a payload that very many pages have.
    first = save(large.groupBy(key).agg(F.min("page_id").alias("refers_to"), F.count("*").alias("pages")).where("pages > 1 and refers_to is not null").select(*key, "refers_to"), "warc-first")
    later = large.join(first, key).where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to", F.lit(0).alias("again"))
    again = pairs.where("n > 1").select("page_id", "digest", F.lit(None).cast("long").alias("refers_to"), F.lit(1).alias("again"))
    facts = later.unionByName(again).groupBy(F.col("page_id").alias("its_id"), F.col("digest").alias("its_digest")).agg(F.max("refers_to").alias("refers_to"), F.max("again").alias("again"))
    joined = rows.join(save(facts, "warc-facts"), rows.page_id.eqNullSafe(F.col("its_id")) & (rows.digest == F.col("its_digest")), "left")
    return joined.select("page_id", "url", "payload", "digest", "refers_to", (F.coalesce("again", F.lit(0)) == 0).alias("alone"))


def write_bundles(records: DataFrame, folder: str, *, frame_bytes: int = 1 << 20, bundle_bytes: int = 64 << 20, level: int = 6, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write the bundles under folder; the index, one row a record."""

    bound_batches(records.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64
        import uuid

        import zstandard
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        packer = zstandard.ZstdCompressor(level=level)
        names = [c.split()[0] for c in INDEX.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 4]
        out = name = None
        frames: list[tuple[int, int]] = []
        at = plain = 0
        held: list[bytes] = []
        told: list[tuple] = []

        def close_frame() -> pa.RecordBatch:
            nonlocal at, plain, held, told
            data = packer.compress(b"".join(held))
            out.write(data)
            lengths = [len(x) for x in held]
            offsets = [0]
            for n in lengths:
                offsets.append(offsets[-1] + n)
            n = len(held)
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*map(list, zip(*told)), [name] * n, [len(frames)] * n, [at] * n, [len(data)] * n, offsets[:-1], lengths], kinds)], names)
            frames.append((len(data), plain))
            at, plain, held, told = at + len(data), 0, [], []
            return batch

        def close_bundle() -> None:
            nonlocal out, frames, at
            out.write(seek_table(frames))
            out.close()
            out, frames, at = None, [], 0

        for b in batches:
            cols = b.columns
            for i in range(b.num_rows):
                page_id, url, payload, digest, refers_to, alone = (c[i] for c in cols)
                body, sha1 = payload.as_buffer().to_pybytes(), base64.b32encode(bytes.fromhex(digest.as_py())).decode()
                record_id = record_name(page_id.as_py(), sha1, alone.as_py())
                record = warc_record(record_id, url.as_py(), body, sha1, refers_to.as_py(), date)
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                held.append(record)
                told.append((page_id.as_py(), record_id))
                plain += len(record)
                if plain >= frame_bytes:
                    yield close_frame()
                    if at >= bundle_bytes:
                        close_bundle()
        if held:
            yield close_frame()
        if out is not None:
            close_bundle()

    return save(records.mapInArrow(write, INDEX), "warc-index")


def read_records(index: DataFrame, folder: str, frames_read=None) -> DataFrame:
    """The records that the index rows name, read by frame; rows of one frame that follow each other share its decoding.

    frames_read, an accumulator, counts the frames decoded.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        unpacker = zstandard.ZstdDecompressor()
        here, plain, source, opened = None, b"", None, None
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for b in batches:
            out: list[tuple] = []
            for bundle, frame, offset, length in zip(*(b.column(c).to_pylist() for c in ("bundle", "frame", "offset", "length"))):
                if here != (bundle, frame):
                    if opened != bundle:
                        if source is not None:
                            source.close()
                        source, opened = store.open_input_file(f"{root}/{bundle}"), bundle
                        size = source.size()
                        tail = source.read_at(9, size - 9)
                        span = 9 + 8 * int.from_bytes(tail[:4], "little")
                        table = read_seek_table(source.read_at(span, size - span))
                        starts = [0]
                        for packed, _ in table:
                            starts.append(starts[-1] + packed)
                    plain = unpacker.decompress(source.read_at(table[frame][0], starts[frame]), max_output_size=table[frame][1])
                    here = (bundle, frame)
                    if frames_read is not None:
                        frames_read.add(1)
                r = parse_record(plain[offset : offset + length])
                out.append(tuple(r[n] for n in names))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)
        if source is not None:
            source.close()

    return index.select("bundle", "frame", "offset", "length").mapInArrow(read, RECORD)


def lookup(index: DataFrame, folder: str, wanted: DataFrame, *, by: str = "page_id", frames_read=None) -> DataFrame:
    """The records whose page_id (or record_id) is among those of wanted; each frame that holds one is decoded once, and no other."""
    found = index.join(wanted.select(by).distinct(), by, "left_semi")
    return read_records(found.repartition("bundle", "frame").sortWithinPartitions("bundle", "frame", "offset"), folder, frames_read)


def archived_pages(pages: DataFrame) -> DataFrame:
    """The digest for the query: write all pages, then read every record back through the index."""
    folder = new_path(pages.sparkSession, "warc")
    return read_records(write_bundles(with_revisits(pages), folder), folder)


PAGES_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS x FROM p),
  b AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + CAST((CAST('0x' || substr(x, 10 * (i // 8) + 1, 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INT)) & 31 AS BIGINT)]), '') AS payload_digest, min(page_id) OVER (PARTITION BY x, payload_bytes) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM b
"""
