"""Format detection: file name and leading bytes to a format id, as column expressions over any table of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from .jsontext import sniff

# Id, priority and extensions of each format, in registry order.
FORMATS = [
    ("pdf", 20, "pdf"),
    ("audio", 20, "mp3 wav pcm aiff aif aifc amr awb ogg flac ac3 aac m4a"),
    ("video", 20, "mp4 mts m2ts avi mov wmv flv webm mkv"),
    ("dbc", 20, "dbc"),
    ("arxml", 20, "arxml"),
    ("a2l", 20, "a2l"),
    ("asc", 20, "asc"),
    ("blf", 20, "blf"),
    ("mf4", 20, "mf4"),
    ("pcap", 20, "pcap"),
    ("pcapng", 20, "pcapng"),
    ("mermaid", 20, "mmd mermaid"),
    ("plantuml", 20, "puml plantuml iuml"),
    ("shapefile", 20, "shp"),
    ("psd", 20, "psd"),
    ("parquet", 20, "parquet"),
    ("avro", 20, "avro"),
    ("bag", 20, "bag"),
    ("stp", 20, "stp step"),
    ("db3", 20, "db3"),
    ("reqif", 20, "reqif"),
    ("hdf5", 20, "h5 hdf5 he5"),
    ("mat", 20, "mat"),
    ("safetensors", 20, "safetensors"),
    ("gguf", 20, "gguf"),
    ("onnx", 20, "onnx"),
    ("ppt", 15, "pptx ppt"),
    ("word", 15, "docx doc"),
    ("hwp", 15, "hwp hwpx"),
    ("excel", 15, "xlsx xlsm xlsb ods xls"),
    ("image", 15, "jpg jpeg png gif bmp webp svg"),
    ("markdown", 10, "md markdown mdown mkdn mkd"),
    ("archive", 5, "zip jar apk tar tgz tar.gz tbz tbz2 tar.bz2 txz tar.xz gz bz2 xz 7z rar dmg"),
    ("csv", 10, "csv tsv"),
    ("json", 10, "json"),
    ("toml", 10, "toml"),
    ("jsonl", 10, "jsonl ndjson jsonlines"),
    ("yaml", 10, "yaml yml"),
    ("proto", 10, "proto"),
    ("latex", 10, "tex latex ltx"),
    ("fallback", -1, ""),
]

# Signatures as (offset, hex) runs; all runs of one signature, any signature of a format.
MAGIC = {
    "pdf": [[(0, "255044462D")]],
    "parquet": [[(0, "50415231")]],
    "avro": [[(0, "4F626A01")]],
    "bag": [[(0, "23524F534241472056322E")]],
    "stp": [[(0, "49534F2D31303330332D32313B")]],
    "db3": [[(0, "53514C69746520666F726D6174203300")]],
    "blf": [[(0, "4C4F4747")]],
    "mf4": [[(0, "4D44462020202020")]],
    "pcap": [[(0, "A1B2C3D4")], [(0, "D4C3B2A1")], [(0, "A1B23C4D")], [(0, "4D3CB2A1")]],
    "pcapng": [[(0, "0A0D0D0A")]],
    "shapefile": [[(0, "0000270A")]],
    "psd": [[(0, "38425053")]],
    "gguf": [[(0, "47475546")]],
    "image": [[(0, "89504E470D0A1A0A")], [(0, "FFD8FF")], [(0, "47494638")], [(0, "424D")], [(0, "52494646"), (8, "57454250")]],
}
ARCHIVE_MAGIC = [[(0, "504B0304")], [(0, "504B0506")], [(257, "7573746172")], [(0, "1F8B")], [(0, "425A68")], [(0, "FD377A585A00")], [(0, "377ABCAF271C")], [(0, "526172211A0700")], [(0, "526172211A070100")]]
CONTENT_FIRST = ("avro", "bag", "stp", "db3", "blf", "mf4", "pcap", "pcapng", "shapefile", "psd", "gguf")
OFFICE = {"xlsx": "zip", "xlsm": "zip", "xlsb": "zip", "ods": "zip", "xls": "ole", "pptx": "zip", "ppt": "ole", "docx": "zip", "doc": "ole", "hwpx": "zip", "hwp": "ole"}
ZIP, EMPTY_ZIP, OLE, HDF5 = "504B0304", "504B0506", "D0CF11E0A1B11AE1", "894844460D0A1A0A"
SNIFF_BYTES = 262


def has(head: Column, signatures: list[list[tuple[int, str]]]) -> Column:
    """Do the leading bytes match one of the signatures? The runs are compared in hex."""
    digits = F.hex(head)
    out = F.lit(False)
    for runs in signatures:
        ok = F.lit(True)
        for offset, h in runs:
            ok = ok & (F.substring(digits, 2 * offset + 1, len(h)) == h)
        out = out | ok
    return out


def container(head: Column) -> Column:
    return F.when(has(head, [[(0, ZIP)], [(0, EMPTY_ZIP)]]), "zip").when(has(head, [[(0, OLE)]]), "ole")


def descriptors(spark: SparkSession) -> DataFrame:
    """id, priority, ord, ext: a row for each extension."""
    rows = [(i, p, n, e) for n, (i, p, exts) in enumerate(FORMATS) for e in exts.split()]
    return spark.createDataFrame(rows, "id string, priority int, ord int, ext string")


def suffixes(name: Column) -> Column:
    """All dotted suffixes of a file name, ASCII lower case: tar.gz, gz of x.tar.gz."""
    parts = F.split(V.ascii_lower(name), r"\.")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "."))).otherwise(F.array().cast("array<string>"))


def text_kind(text: Column) -> Column:
    """jsonl, json, proto, latex or null, by content."""
    import pandas as pd

    @F.pandas_udf("string")
    def kind(texts):
        return texts.map(lambda t: sniff(t) if isinstance(t, str) else None)

    kind.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return kind(text)


def detect(files: DataFrame, *, name: str = "name", head: str | None = None, text: str | None = None) -> DataFrame:
    """The files with format and matched_by (extension, content, ambiguous-container or fallback).

    head: leading bytes, 262 of them if there are; text: a text sample. The extension
    decides first, if the bytes don't contradict it; then containers, signatures, text.
    Files are joined to the few dozen descriptors by suffix, an equi-join on a fixed table.
    """
    b = F.col(head) if head else F.lit(None).cast("binary")
    keyed = files.withColumn("_file", F.struct(*files.columns))
    magic = F.lit(True)
    for i, signatures in MAGIC.items():
        magic = F.when(F.col("id") == i, has(b, signatures)).otherwise(magic)
    # Tails (dmg) can't be told from leading bytes; svg has no signature.
    magic = F.when(F.col("id") == "archive", has(b, ARCHIVE_MAGIC) | F.col("ext").isin("dmg")).when((F.col("id") == "image") & (F.col("ext") == "svg"), True).otherwise(magic)
    tagged = keyed.withColumn("_id", F.xxhash64("_file"))
    found = tagged.select("_id", "_file", *[F.col(c) for c in files.columns], F.explode(suffixes(F.col(name))).alias("ext")).join(F.broadcast(descriptors(files.sparkSession)), "ext")
    found = found.where(b.isNull() | magic).groupBy("_id", "_file").agg(F.max_by(F.struct("id", "ext"), F.struct("priority", -F.col("ord"))).alias("hit")).select("_id", "_file", "hit.id", "hit.ext")
    out = tagged.join(found.select("_id", F.col("_file").alias("_f2"), F.col("id").alias("_format"), F.col("ext").alias("_ext")).withColumnRenamed("_id", "_id2"), (F.col("_id") == F.col("_id2")) & F.col("_file").eqNullSafe(F.col("_f2")), "left")
    box = container(b)
    expected = F.create_map(*[F.lit(x) for kv in OFFICE.items() for x in kv])
    clash = box.isNotNull() & F.try_element_at(expected, F.coalesce("_ext", F.lit(""))).isNotNull() & (F.try_element_at(expected, F.coalesce("_ext", F.lit(""))) != box)
    content = F.when(has(b, [[(0, HDF5)]]), "hdf5").when(F.substring(b, 1, 6) == F.lit(b"MATLAB"), "mat")
    for i in CONTENT_FIRST:
        content = content.when(has(b, MAGIC[i]), i)
    content = content.when(has(b, ARCHIVE_MAGIC[2:]), "archive")
    if text:
        content = content.otherwise(text_kind(F.col(text)))
    by_name = F.col("_format").isNotNull()
    out = out.withColumn("_content", F.when(~by_name & box.isNull(), content))
    return out.select(
        *files.columns,
        F.when(by_name & ~F.coalesce(clash, F.lit(False)), F.col("_format")).when(by_name | box.isNotNull(), "fallback").otherwise(F.coalesce("_content", F.lit("fallback"))).alias("format"),
        F.when(by_name & ~F.coalesce(clash, F.lit(False)), "extension").when(by_name | box.isNotNull(), "ambiguous-container").when(F.col("_content").isNotNull(), "content").otherwise("fallback").alias("matched_by"),
    )


def probe(data: bytes) -> str | None:
    """What a zip or OLE container holds: excel, word, ppt, hwp or archive."""
    import io
    import re
    import zipfile

    if data[:2] == b"PK":
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                names = z.namelist()
                kind = z.read("mimetype")[:200].decode("latin-1") if "mimetype" in names else ""
        except (zipfile.BadZipFile, KeyError):
            return None
        if "spreadsheet" in kind:
            return "excel"
        if "hwp" in kind:
            return "hwp"
        for prefix, out in (("xl/", "excel"), ("word/", "word"), ("ppt/", "ppt"), ("Contents/", "hwp")):
            if any(n.startswith(prefix) for n in names):
                return out
        return "archive"
    if data[:8] == bytes.fromhex(OLE):
        names = {m.decode("utf-16-le", "ignore") for m in re.findall(rb"((?:[ -~]\x00){3,32})", data)}
        for mark, out in (("Workbook", "excel"), ("Book", "excel"), ("WordDocument", "word"), ("PowerPoint Document", "ppt"), ("FileHeader", "hwp")):
            if mark in names:
                return out
    return None
