"""Binary formats: databases, attribute tables, geometry, tensors, model graphs, archives, sound, pictures, scientific containers.

Headers and indexes are read; payloads (tensor data, datasets, samples) only where a function asks for them.
"""

from __future__ import annotations

import io
import json
import math
import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

from .files import Summary, hex_lines, parser, preview


@parser("db3", "sqlite")
def db3(data: bytes, tables: int = 12, rows: int = 100) -> Summary:
    """Schema and the first rows of user tables, through the standard library's reader; nulls show as NULL."""
    import sqlite3

    s = Summary("DB3", "SQLite database")
    if data[:16] != b"SQLite format 3\0":
        s.warnings.append("the first sixteen bytes are no database header")
        return preview(s, data)
    size = struct.unpack_from(">H", data, 16)[0]
    s.facts = [("Page size", 65536 if size == 1 else size), ("Pages", struct.unpack_from(">I", data, 28)[0])]
    con = sqlite3.connect(":memory:")
    try:
        con.deserialize(data)
        schema = con.execute("SELECT type, name, tbl_name, rootpage, sql FROM sqlite_master").fetchall()
        s.add("Schema", ["Type", "Name", "Table", "Root page", "SQL"], [list(r) for r in schema])
        user = [r[1] for r in schema if r[0] == "table" and not r[1].startswith("sqlite_")]
        if {"topics", "messages"} <= {*user}:
            s.facts.append(("Recording", "ROS2 bag"))
        for name in user[:tables]:
            quoted = '"' + name.replace('"', '""') + '"'
            cur = con.execute(f"SELECT * FROM {quoted} LIMIT {rows}")
            s.add(name, [c[0] for c in cur.description], [["NULL" if v is None else v.hex() if isinstance(v, bytes) else v for v in r] for r in cur])
    except sqlite3.Error as e:
        s.warnings.append(f"SQLite: {e}")
    finally:
        con.close()
    return s


@parser("dbf")
def dbf(data: bytes, encoding: str = "utf-8") -> Summary:
    """Typed attributes: deleted records skipped, 0x1A ends them."""
    if len(data) < 32:
        raise ValueError("the table ends inside its header")
    declared, head, width = struct.unpack_from("<IHH", data, 4)
    if not 33 <= head <= len(data) or width < 1:
        raise ValueError("the header's size fits neither the file nor a record")
    fields, at = [], 32
    while at + 32 <= head and data[at] != 0x0D:
        name = data[at : at + 11].partition(b"\0")[0].decode(encoding, "replace").strip()
        fields.append((name or f"FIELD_{len(fields)}", chr(data[at + 11]), data[at + 16]))
        at += 32
    if not fields:
        raise ValueError("the header describes no field")

    def value(raw: bytes, kind: str):
        t = raw.decode(encoding, "replace").replace("\0", "").strip()
        if kind in "NF":
            try:
                return n if t and math.isfinite(n := float(t)) else None
            except ValueError:
                return None
        if kind == "L":
            return True if t in [*"YyTt"] else False if t in [*"NnFf"] else None
        if kind == "D":
            return f"{t[:4]}-{t[4:6]}-{t[6:]}" if re.fullmatch(r"\d{8}", t) else t or None
        return t

    rows, at = [], head
    while at + width <= len(data) and data[at] != 0x1A:
        if data[at] != 0x2A:
            row, p = [], at + 1
            for _, kind, n in fields:
                row.append(value(data[p : p + n], kind))
                p += n
            rows.append(row)
        at += width
    s = Summary("DBF", "Attribute table", [("Records", declared), ("Fields", len(fields))])
    if len(rows) < declared:
        s.warnings.append(f"DBF declares {declared} records; {len(rows)} were readable.")
    s.add("Fields", ["Name", "Type", "Length"], [list(f) for f in fields])
    return s.add("Records", [f[0] for f in fields], rows)


def ring_area(ring: list) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) / 2


def in_ring(p, ring: list) -> bool:
    inside = False
    for a, b in zip(ring, ring[-1:] + ring[:-1]):
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
            inside = not inside
    return inside


def polygons(rings: list[list]) -> list[list]:
    """Clockwise rings are outer; a hole goes to the smallest outer ring with its first point, or becomes a polygon, turned round."""
    out = [[r] for r in rings if ring_area(r) < 0]
    for hole in (r for r in rings if ring_area(r) >= 0):
        owners = sorted((abs(ring_area(p[0])), i) for i, p in enumerate(out) if len(p[0]) and ring_area(p[0]) < 0 and in_ring(hole[0], p[0]))
        if owners:
            out[owners[0][1]].append(hole)
        else:
            out.append([hole[::-1] if ring_area(hole) > 0 else hole])
    return out


@parser("shp")
def shapefile(data: bytes) -> Summary:
    """Points, multipoints, lines and polygons, with Z and M kinds read in two dimensions."""
    if len(data) < 100 or struct.unpack_from(">i", data)[0] != 9994:
        raise ValueError("Shapefile header is invalid.")
    s, rows, at = Summary("SHP", "Shapefile"), [], 100
    while at + 8 <= len(data):
        number, words = struct.unpack_from(">ii", data, at)
        end, p = at + 8 + words * 2, at + 8
        if words < 2 or end > len(data):
            s.warnings.append("the last record is cut off")
            break
        kind = struct.unpack_from("<i", data, p)[0]
        try:
            point = lambda q: list(struct.unpack_from("<2d", data, q))
            if kind % 10 == 1 and kind < 30:
                rows.append([number, "Point", point(p + 4)])
            elif kind % 10 == 8:
                n = struct.unpack_from("<i", data, p + 36)[0]
                rows.append([number, "MultiPoint", [point(p + 40 + 16 * i) for i in range(n)]])
            elif kind % 10 in (3, 5):
                parts, n = struct.unpack_from("<2i", data, p + 36)
                cuts = [*struct.unpack_from(f"<{parts}i", data, p + 44), n]
                base = p + 44 + 4 * parts
                lines = [[point(base + 16 * i) for i in range(a, b)] for a, b in zip(cuts, cuts[1:])]
                if kind % 10 == 3:
                    rows.append([number, "LineString" if parts == 1 else "MultiLineString", lines[0] if parts == 1 else lines])
                else:
                    shapes = polygons([r[:-1] if r[0] == r[-1] else r for r in lines])
                    rows.append([number, "Polygon" if len(shapes) == 1 else "MultiPolygon", shapes[0] if len(shapes) == 1 else shapes])
            elif kind:
                s.warnings.append(f"Record {number}: unsupported kind {kind}.")
        except struct.error:
            s.warnings.append(f"Record {number}: truncated.")
        at = end
    box = struct.unpack_from("<4d", data, 36)
    s.facts = [("Features", len(rows)), ("Box", ", ".join(map(str, box)))]
    return s.add("Features", ["id", "type", "coordinates"], [[n, k, json.dumps(c)] for n, k, c in rows])


#: Bits of an element.
DTYPE_BITS = {"F64": 64, "F32": 32, "F16": 16, "BF16": 16, "I64": 64, "I32": 32, "I16": 16, "I8": 8, "U64": 64, "U32": 32, "U16": 16, "U8": 8, "BOOL": 8, "C64": 64, "F8_E4M3": 8, "F8_E5M2": 8, "F8_E8M0": 8, "F6_E2M3": 6, "F6_E3M2": 6, "F4": 4}


@parser("safetensors")
def safetensors(data: bytes, total: int | None = None) -> Summary:
    """The tensor index in storage order, and whether byte ranges fit types, shapes and each other."""
    s = Summary("SAFETENSORS", "Safetensors tensor collection")
    total = len(data) if total is None else total
    size = struct.unpack_from("<Q", data)[0] if len(data) >= 8 else -1
    if size < 0 or 8 + size > total:
        s.warnings.append("the header's length is not there or too large")
        return s
    try:
        head = json.loads(data[8 : 8 + size].decode())
        if not isinstance(head, dict):
            raise ValueError("not an object")
    except ValueError:
        s.warnings.append("the header is no JSON object")
        return s
    whole = lambda xs: isinstance(xs, list) and all(isinstance(x, int) and not isinstance(x, bool) and x >= 0 for x in xs)
    meta = head.pop("__metadata__", {})
    if not isinstance(meta, dict) or any(not isinstance(v, str) for v in meta.values()):
        s.warnings.append('metadata values that are not text are left out')
    meta = {k: v for k, v in meta.items() if isinstance(v, str)} if isinstance(meta, dict) else {}
    rows, bad, unknown, odd, ranges = [], False, False, False, []
    for name, e in head.items():
        e = e if isinstance(e, dict) else {}
        kind, shape, span = e.get("dtype"), e.get("shape"), e.get("data_offsets")
        good_span = whole(span) and len(span) == 2
        bad |= not isinstance(kind, str) or not whole(shape) or not good_span
        shape, (a, b) = shape if whole(shape) else [], span if good_span else (0, 0)
        n = math.prod(shape)
        if n >= 1 << 53:
            bad, n = True, 0
        bits = DTYPE_BITS.get(kind)
        unknown |= bits is None
        odd |= bits is not None and n * bits != 8 * max(0, b - a)
        if good_span and a <= b <= total - 8 - size:
            ranges.append((a, b))
        else:
            odd = True
        rows.append([name, kind if isinstance(kind, str) else "unknown", " × ".join(map(str, shape)) or "scalar", n, a, b])
    covered = 0
    for a, b in sorted(ranges):
        odd |= a != covered
        covered = max(covered, b)
    odd |= covered != total - 8 - size
    for flag, text in ((bad, "Some tensor entries have an invalid dtype, shape, or data offset declaration."), (unknown, "Some tensors use an unknown dtype."), (odd, "Some tensor byte ranges are inconsistent with their dtype and shape.")):
        if flag:
            s.warnings.append(text)
    rows.sort(key=lambda r: (r[4], r[5]))
    s.facts = [("Tensors", len(rows)), ("Parameters", sum(r[3] for r in rows)), ("Data types", ", ".join(sorted({r[1] for r in rows})) or "—")]
    s.add("Tensors", ["name", "dtype", "shape", "elements", "begin", "end"], rows)
    return s.add("Metadata", ["key", "value"], [[k, v] for k, v in meta.items()])


#: (elements, bytes) of a block by storage type number and name.
GGML = {0: ("F32", 1, 4), 1: ("F16", 1, 2), 2: ("Q4_0", 32, 18), 3: ("Q4_1", 32, 20), 6: ("Q5_0", 32, 22), 7: ("Q5_1", 32, 24), 8: ("Q8_0", 32, 34), 9: ("Q8_1", 32, 36), 10: ("Q2_K", 256, 84), 11: ("Q3_K", 256, 110), 12: ("Q4_K", 256, 144), 13: ("Q5_K", 256, 176), 14: ("Q6_K", 256, 210), 15: ("Q8_K", 256, 292), 24: ("I8", 1, 1), 25: ("I16", 1, 2), 26: ("I32", 1, 4), 27: ("I64", 1, 8), 28: ("F64", 1, 8), 30: ("BF16", 1, 2)}


@parser("gguf")
def gguf(data: bytes) -> Summary:
    """Metadata and tensor index of versions 1 to 3 in either byte order, with a check of the layout."""
    s = Summary("GGUF", "GGUF model")
    if data[:4] != b"GGUF":
        s.warnings.append("The file does not start with GGUF.")
        return preview(s, data)
    order = "<" if struct.unpack_from("<I", data, 4)[0] < 1 << 16 else ">"
    at = 4

    def take(fmt: str):
        nonlocal at
        v = struct.unpack_from(order + fmt, data, at)
        at += struct.calcsize(order + fmt)
        return v[0]

    version = take("I")
    size = "I" if version == 1 else "Q"

    def string() -> str:
        nonlocal at
        n = take(size)
        at += n
        return data[at - n : at].decode("utf-8", "replace")

    def value(kind: int):
        if kind == 8:
            return string()
        if kind == 9:
            inner, n = take("I"), take(size)
            return [value(inner) for _ in range(n)]
        return take("BbHhIif?__QqdX"[kind]) if kind not in (8, 9) else None

    count, keys = take(size), take(size)
    meta = {}
    for _ in range(keys):
        k = string()
        if k in meta:
            s.warnings.append(f"Repeated key: {k}")
        meta[k] = value(take("I"))
    tensors = []
    for _ in range(count):
        name, dims = string(), take("I")
        shape = [take(size) for _ in range(dims)]
        kind, offset = take("I"), take("Q")
        label, block, width = GGML.get(kind, (f"type {kind}", 0, 0))
        n = math.prod(shape)
        bytes_ = n // block * width if block and n % block == 0 else None
        tensors.append([name, label, " × ".join(map(str, shape)) or "scalar", n, offset, bytes_])
    align = meta.get("general.alignment", 32)
    if not isinstance(align, int) or align < 1 or align & (align - 1):
        s.warnings.append("The alignment is not a power of two.")
        align = 32
    start = -(-at // align) * align
    s.warnings += [f"{t[0]}: offset is not aligned." for t in tensors if t[4] % align] + [f"{t[0]}: data extends past the end of the file." for t in tensors if t[5] is not None and start + t[4] + t[5] > len(data)]
    kinds = Counter(t[1] for t in tensors)
    s.facts = [("Version", version), ("Architecture", meta.get("general.architecture", "-")), ("Tensors", count), ("Parameters", sum(t[3] for t in tensors)), ("Dominant type", kinds.most_common(1)[0][0] if kinds else "-")]
    shown = lambda v: f"[{len(v)} items] {', '.join(map(str, v[:8]))}{f', … (+{len(v) - 8})' if len(v) > 8 else ''}" if isinstance(v, list) else v
    s.add("Metadata", ["key", "value"], [[k, shown(v)] for k, v in meta.items()])
    return s.add("Tensors", ["name", "dtype", "shape", "elements", "offset", "bytes"], tensors)


def wire(data: bytes) -> Iterator[tuple[int, object]]:
    """(field, value) of a protobuf message: ints, or bytes for lengths and fixed widths."""
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            yield tag >> 3, data[at : at + n]
            at += n
        elif kind == 2:
            n = varint()
            if at + n > len(data):
                raise ValueError("truncated message")
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            raise ValueError(f"wire type {kind}")


#: Element types of tensors by number.
ONNX_TYPES = ["undefined", "float", "uint8", "int8", "uint16", "int16", "int32", "int64", "string", "bool", "float16", "double", "uint32", "uint64", "complex64", "complex128", "bfloat16", "float8e4m3fn", "float8e4m3fnuz", "float8e5m2", "float8e5m2fnuz", "uint4", "int4", "float4e2m1"]


@parser("onnx")
def onnx(data: bytes) -> Summary:
    """Nodes, values and initializers of the graph and its sub-graphs; payloads are skipped."""
    s = Summary("ONNX", "ONNX model")
    nodes, values, tensors, opsets, facts = [], [], [], [], {}
    signed = lambda v: v - (1 << 64) if isinstance(v, int) and v >> 63 else v
    text = lambda b: b.decode("utf-8", "replace")

    def ints(v) -> list[int]:
        if isinstance(v, int):
            return [signed(v)]
        return [signed(x) for _, x in wire(b"".join(b"\x08" + p for p in re.findall(rb"[\x80-\xff]*[\x00-\x7f]", v, re.S)))]

    def graph(b: bytes, where: str) -> None:
        for f, v in wire(b):
            if f == 1:
                n = {"inputs": [], "outputs": [], "name": "", "op": "", "attrs": []}
                for g, w in wire(v):
                    if g in (1, 2):
                        n["inputs" if g == 1 else "outputs"].append(text(w))
                    elif g == 3:
                        n["name"] = text(w)
                    elif g == 4:
                        n["op"] = text(w)
                    elif g == 5:
                        parts = list(wire(w))
                        label = next((text(x) for k, x in parts if k == 1), "")
                        n["attrs"].append(label)
                        for k, x in parts:
                            if k in (6, 11):
                                graph(x, f"{where}/{n['name'] or len(nodes)}.{label}")
                nodes.append([where, len(nodes), n["name"], n["op"], json.dumps(n["inputs"]), json.dumps(n["outputs"]), ", ".join(n["attrs"])])
            elif f == 2:
                facts.setdefault("Graph", text(v))
            elif f == 5:
                dims, kind, name, outside = [], 0, "", False
                for g, w in wire(v):
                    if g == 1:
                        dims += ints(w)
                    elif g == 2:
                        kind = w
                    elif g == 8:
                        name = text(w)
                    outside |= g == 14 and w == 1
                tensors.append([where, name, ONNX_TYPES[kind] if kind < len(ONNX_TYPES) else str(kind), " × ".join(map(str, dims)) or "scalar", str(math.prod(dims)), outside])
            elif f in (11, 12, 13):
                values.append([where, {11: "input", 12: "output", 13: "value"}[f], next((text(w) for g, w in wire(v) if g == 1), "")])

    try:
        for f, v in wire(data):
            if f == 1:
                facts["IR version"] = v
            elif f in (2, 3):
                facts["Producer" if f == 2 else "Producer version"] = text(v)
            elif f == 7:
                graph(v, "main")
            elif f == 8:
                d = dict(wire(v))
                opsets.append([text(d.get(1, b"")) or "ai.onnx", d.get(2, 0)])
    except (IndexError, ValueError) as e:
        s.warnings.append(f"Parsing stopped: {e}")
    if "IR version" not in facts:
        s.warnings.append("The model has no IR version.")
    s.facts = [*facts.items(), ("Nodes", len(nodes)), ("Initializers", len(tensors)), ("External tensors", sum(t[5] for t in tensors))]
    s.add("Nodes", ["graph", "node_id", "name", "op", "inputs", "outputs", "attributes"], nodes).add("Values", ["graph", "kind", "name"], values)
    return s.add("Initializers", ["graph", "name", "dtype", "shape", "elements", "external"], tensors).add("Opsets", ["domain", "version"], opsets)


def zip_declared(data: bytes) -> tuple[float, float]:
    """(plain bytes, entries) that the central directory declares; infinite for ZIP64 or a malformed one."""
    end = data.rfind(b"PK\x05\x06", max(0, len(data) - 65557))
    if end < 0 or end + 22 > len(data):
        return math.inf, math.inf
    count, _, at = struct.unpack_from("<HII", data, end + 10)
    if count == 0xFFFF or at == 0xFFFFFFFF:
        return math.inf, math.inf
    total = 0
    for _ in range(count):
        if data[at : at + 4] != b"PK\x01\x02" or at + 46 > len(data):
            return math.inf, math.inf
        plain, name, extra, note = struct.unpack_from("<IHHH", data, at + 24)
        if plain == 0xFFFFFFFF:
            return math.inf, math.inf
        total, at = total + plain, at + 46 + name + extra + note
    return total, count


@parser("archive", "zip", "tar", "gz")
def archive(data: bytes, *, entries: int = 100_000, budget: int = 1 << 30) -> Summary:
    """Entries of zip, tar (plain, gzip, bzip2, xz) and single compressed files; a declared size over the budget isn't opened."""
    import tarfile
    import zipfile

    s, rows = Summary("ARCHIVE", "Archive"), []
    if data[:2] == b"PK":
        plain, _ = zip_declared(data)
        if plain != math.inf and plain > budget:
            s.warnings.append("The declared size exceeds the budget.")
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            rows = [[i, e.filename, e.is_dir(), e.file_size, e.compress_size, bool(e.flag_bits & 1)] for i, e in enumerate(z.infolist()[:entries])]
    else:
        try:
            with tarfile.open(fileobj=io.BytesIO(data)) as t:
                for i, e in enumerate(t):
                    if i >= entries:
                        s.warnings.append("The list of entries is cut.")
                        break
                    rows.append([i, e.name + "/" * e.isdir(), e.isdir(), e.size, e.size, False])
        except tarfile.TarError:
            if data[:2] == b"\x1f\x8b":
                plain = zlib.decompressobj(31).decompress(data, budget)
                rows = [[0, "content", False, len(plain), len(data), False]]
            else:
                s.warnings.append("No archive reader takes this file.")
    s.facts = [("Entries", len(rows)), ("Bytes", sum(r[3] for r in rows))]
    return s.add("Entries", ["entry_id", "path", "is_dir", "size", "packed", "encrypted"], rows)


def wav_header(data: bytes) -> dict:
    """format (1 PCM, 3 float), channels, rate, bits, where samples start and how many frames."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, out = 12, {}
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if kind == 0xFFFE and size >= 26:
                kind = struct.unpack_from("<H", data, at + 32)[0]
            out |= {"format": kind, "channels": channels, "rate": rate, "bits": bits}
        elif name == b"data" and out:
            size = min(size, len(data) - at - 8)
            return out | {"start": at + 8, "frames": size // (out["channels"] * out["bits"] // 8)}
        at += 8 + size + size % 2
    raise ValueError("no samples")


def wav_samples(data: bytes, first: int = 0, count: int | None = None):
    """float32 samples (frame, channel) of a range of frames."""
    import numpy as np

    h = wav_header(data)
    width = h["bits"] // 8
    stop = h["frames"] if count is None else min(h["frames"], first + count)
    raw = np.frombuffer(data, np.uint8, (stop - first) * width * h["channels"], h["start"] + first * width * h["channels"])
    if h["format"] == 3 and width == 4:
        x = raw.view("<f4").astype(np.float32)
    elif width == 1:
        x = (raw.astype(np.float32) - 128) / 128
    elif width == 3:
        b = raw.reshape(-1, 3).astype(np.int32)
        x = (((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / float(1 << 23)).astype(np.float32)
    else:
        x = (raw.view(f"<i{width}") / float(1 << 8 * width - 1)).astype(np.float32)
    return x.reshape(-1, h["channels"])


def wav_encode(samples, rate: int) -> bytes:
    """16-bit PCM of float samples (frame, channel)."""
    import numpy as np

    x = np.clip(np.asarray(samples, np.float32), -1, 1)
    pcm = np.where(x < 0, x * 32768, x * 32767).astype("<i2").tobytes()
    ch = x.shape[1] if x.ndim > 1 else 1
    return b"RIFF" + struct.pack("<I", 36 + len(pcm)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, ch, rate, rate * ch * 2, ch * 2, 16) + b"data" + struct.pack("<I", len(pcm)) + pcm


@parser("wav")
def wav(data: bytes) -> Summary:
    h = wav_header(data)
    return Summary("WAV", "Sound", [(k.capitalize(), h[k]) for k in ("format", "channels", "rate", "bits", "frames")] + [("Seconds", round(h["frames"] / h["rate"], 6))])


def sample_frames(spark, path: str, *, frames: int = 1 << 16):
    """frame, channel, sample of the WAV files under path, cut in blocks of frames inside the task that holds the file."""
    def work(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                data = bytes(content)
                h = wav_header(data)
                for at in range(0, h["frames"], frames):
                    x = wav_samples(data, at, frames)
                    yield pd.DataFrame({"path": name, "frame": np.repeat(np.arange(at, at + len(x)), h["channels"]), "channel": np.tile(np.arange(h["channels"], dtype=np.int32), len(x)), "sample": x.ravel()})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(work, "path string, frame long, channel int, sample float")


#: kbit/s by (version 1, layer III) and (version 2, layer III); rates by version bits.
MP3_RATES = {1: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), 2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
MP3_HERTZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


def mp3_frames(data: bytes) -> Iterator[tuple[int, int, int, int]]:
    """(offset, length, rate, samples) of layer III frames, without decoding: ID3 skipped, a frame counts if another follows or the file ends."""
    at = 0
    if data[:3] == b"ID3" and len(data) >= 10:
        at = 10 + (data[6] << 21 | data[7] << 14 | data[8] << 7 | data[9])

    def frame(p: int):
        if p + 4 > len(data) or data[p] != 0xFF or data[p + 1] & 0xE0 != 0xE0:
            return None
        version, layer = data[p + 1] >> 3 & 3, data[p + 1] >> 1 & 3
        bits, hertz, pad = data[p + 2] >> 4, data[p + 2] >> 2 & 3, data[p + 2] >> 1 & 1
        if version == 1 or layer != 1 or bits in (0, 15) or hertz == 3:
            return None
        samples = 1152 if version == 3 else 576
        rate = MP3_HERTZ[version][hertz]
        return samples // 8 * MP3_RATES[1 if version == 3 else 2][bits] * 1000 // rate + pad, rate, samples

    first = True
    while at + 4 <= len(data):
        f = frame(at)
        if f and (at + f[0] >= len(data) or frame(at + f[0])):
            tag = data[at : at + f[0]]
            if not (first and (b"Xing" in tag[:200] or b"Info" in tag[:200] or b"VBRI" in tag[:200])):
                yield at, *f
            first = False
            at += f[0]
        else:
            at += 1


@parser("mp3")
def mp3(data: bytes) -> Summary:
    n = samples = rate = 0
    for _, _, rate, k in mp3_frames(data):
        n, samples = n + 1, samples + k
    return Summary("MP3", "Sound", [("Frames", n), ("Rate", rate), ("Samples", samples), ("Seconds", round(samples / rate, 6) if rate else 0)])


@parser("psd")
def psd(data: bytes) -> Summary:
    if data[:4] != b"8BPS" or len(data) < 26:
        raise ValueError("not a PSD file")
    version, channels, height, width, depth, mode = struct.unpack_from(">H6xHIIHH", data, 4)
    return Summary("PSD", "Layered picture", [("Version", version), ("Channels", channels), ("Width", width), ("Height", height), ("Depth", depth), ("Mode", mode)])


#: Type and leading bytes (offset 0) of pictures.
IMAGE_MAGIC = {"image/png": b"\x89PNG\r\n\x1a\n", "image/jpeg": b"\xff\xd8\xff", "image/gif": b"GIF8", "image/bmp": b"BM"}


def image_type(data: bytes) -> str | None:
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "image/webp"
    if re.match(rb"\s*(<\?xml[^>]*>\s*)?(<!--.*?-->\s*)*(<!DOCTYPE[^>]*>\s*)?<svg\b", data[:2048], re.S | re.I):
        return "image/svg+xml"
    return next((t for t, m in IMAGE_MAGIC.items() if data.startswith(m)), None)


@parser("image")
def image(data: bytes) -> Summary:
    kind = image_type(data)
    moving = (kind == "image/gif" and data.count(b"\x21\xf9\x04") > 1) or (kind == "image/png" and b"acTL" in data[:4096]) or (kind == "image/webp" and b"ANIM" in data[:64])
    size = struct.unpack_from(">II", data, 16) if kind == "image/png" else struct.unpack_from("<HH", data, 6) if kind == "image/gif" else ("-", "-")
    return Summary("IMAGE", "Picture", [("Type", kind or "-"), ("Animated", moving), ("Width", size[0]), ("Height", size[1])])


#: Element and array types of level 5 files.
MI = {1: ("int8", 1), 2: ("uint8", 1), 3: ("int16", 2), 4: ("uint16", 2), 5: ("int32", 4), 6: ("uint32", 4), 7: ("single", 4), 9: ("double", 8), 12: ("int64", 8), 13: ("uint64", 8), 16: ("utf8", 1)}
MX = {1: "cell", 2: "struct", 3: "object", 4: "char", 5: "sparse", 6: "double", 7: "single", 8: "int8", 9: "uint8", 10: "int16", 11: "uint16", 12: "int32", 13: "uint32", 14: "int64", 15: "uint64"}


@parser("mat")
def mat(data: bytes) -> Summary:
    """Variables of level 4 and 5 files; level 7.3 is HDF5."""
    s, rows = Summary("MAT", "MATLAB data"), []
    if b"\x89HDF\r\n\x1a\n" in (data[:8], data[512:520]):
        return hdf5(data)
    order = {b"IM": "<", b"MI": ">"}.get(data[126:128])
    if order:
        s.facts.append(("Level", 5))

        def element(b: bytes, at: int) -> tuple[int, bytes, int]:
            kind = struct.unpack_from(order + "I", b, at)[0]
            if kind >> 16:
                return kind & 0xFFFF, b[at + 4 : at + 4 + (kind >> 16)], at + 8
            n = struct.unpack_from(order + "I", b, at + 4)[0]
            return kind, b[at + 8 : at + 8 + n], at + 8 + (n if kind == 15 else -(-n // 8) * 8)

        at = 128
        try:
            while at + 8 <= len(data):
                kind, body, at = element(data, at)
                if kind == 15:
                    kind, body, _ = element(zlib.decompress(body), 0)
                if kind != 14:
                    continue
                _, flags, p = element(body, 0)
                _, dims, p = element(body, p)
                _, name, p = element(body, p)
                word = struct.unpack_from(order + "I", flags)[0]
                shape = struct.unpack(f"{order}{len(dims) // 4}i", dims)
                rows.append([name.decode("latin-1"), MX.get(word & 255, str(word & 255)), " × ".join(map(str, shape)), "complex" if word & 0x800 else "real"])
        except (struct.error, zlib.error) as e:
            s.warnings.append(f"Parsing stopped: {e}")
    else:
        def level4(o: str) -> list:
            out, at = [], 0
            while at + 20 <= len(data):
                kind, m, n, imag, size = struct.unpack_from(o + "5I", data, at)
                width = {0: 8, 1: 4, 2: 4, 3: 2, 4: 2, 5: 1}.get(kind // 10 % 10)
                if kind > 4999 or width is None or imag > 1 or not 0 < size < 256:
                    break
                out.append([data[at + 20 : at + 19 + size].decode("latin-1"), ("double", "single", "int32", "int16", "uint16", "uint8")[kind // 10 % 10], f"{m} × {n}", "complex" if imag else "real"])
                at += 20 + size + m * n * width * (1 + imag)
            return out

        rows = max(level4("<"), level4(">"), key=len)
        s.facts.append(("Level", 4))
        if not rows:
            s.warnings.append("No variables were found.")
    s.facts.append(("Variables", len(rows)))
    return s.add("Variables", ["name", "class", "size", "kind"], rows)


#: Names of datatype classes.
H5_CLASSES = ("integer", "float", "time", "string", "bitfield", "opaque", "compound", "reference", "enum", "variable-length", "array")


@parser("hdf5", "h5")
def hdf5(data: bytes) -> Summary:
    """Groups and datasets with shape and type; payloads aren't read. Old-style groups and compact links."""
    s, rows = Summary("HDF5", "Hierarchical data"), []
    base = next((p for p in (0, *(512 << i for i in range(20))) if data[p : p + 8] == b"\x89HDF\r\n\x1a\n"), -1)
    if base < 0:
        s.warnings.append("No HDF5 signature.")
        return preview(s, data)
    version = data[base + 8]
    wide, long_ = (data[base + 13], data[base + 14]) if version < 2 else (data[base + 9], data[base + 10])
    num = lambda at, n: int.from_bytes(data[at : at + n], "little")
    seen: set[int] = set()

    def messages(at: int) -> Iterator[tuple[int, int, int]]:
        """(kind, offset, size) of an object's header messages."""
        if data[at : at + 4] == b"OHDR":
            flags = data[at + 5]
            p = at + 6 + (16 if flags & 32 else 0) + (4 if flags & 16 else 0)
            n = 1 << (flags & 3)
            spans = [(p + n, p + n + num(p, n))]
            while spans:
                p, end = spans.pop(0)
                while p + 4 <= end:
                    kind, size = data[p], num(p + 1, 2)
                    p += 4 + (2 if flags & 4 else 0)
                    if kind == 16:
                        where, length = num(p, wide) + base, num(p + wide, long_)
                        spans.append((where + 4, where + length - 4))
                    else:
                        yield kind, p, size
                    p += size
        else:
            spans = [(at + 16, at + 16 + num(at + 8, 4))]
            while spans:
                p, end = spans.pop(0)
                while p + 8 <= end:
                    kind, size = num(p, 2), num(p + 2, 2)
                    if kind == 16:
                        spans.append((num(p + 8, wide) + base, num(p + 8, wide) + base + num(p + 8 + wide, long_)))
                    else:
                        yield kind, p + 8, size
                    p += 8 + size

    def tree(at: int, heap: int) -> Iterator[tuple[str, int]]:
        if data[at : at + 4] == b"TREE":
            p = at + 8 + 2 * wide + long_
            for i in range(num(at + 6, 2)):
                yield from tree(num(p + i * (wide + long_), wide) + base, heap)
        elif data[at : at + 4] == b"SNOD":
            for i in range(num(at + 6, 2)):
                p = at + 8 + i * (2 * wide + 24)
                name = heap + num(p, wide)
                yield data[name : data.index(b"\0", name)].decode("utf-8", "replace"), num(p + wide, wide) + base

    def visit(at: int, path: str, depth: int) -> None:
        if at in seen or depth > 64:
            return
        seen.add(at)
        shape = kind = None
        links: list[tuple[str, int]] = []
        group = False
        for m, p, _ in messages(at):
            if m == 1:
                skip = 8 if data[p] == 1 else 4
                shape = [num(p + skip + i * long_, long_) for i in range(data[p + 1])]
            elif m == 3:
                kind = f"{H5_CLASSES[min(data[p] & 15, 10)]}{8 * num(p + 4, 4)}"
            elif m == 17:
                group = True
                heap = num(p + wide, wide) + base
                links += tree(num(p, wide) + base, num(heap + 8 + 2 * long_, wide) + base)
            elif m == 2:
                group = True
            elif m == 6:
                group = True
                flags, q = data[p + 1], p + 2
                hard = True
                if flags & 8:
                    hard, q = data[q] == 0, q + 1
                q += (8 if flags & 4 else 0) + (1 if flags & 16 else 0)
                n = 1 << (flags & 3)
                size = num(q, n)
                if hard:
                    links.append((data[q + n : q + n + size].decode("utf-8", "replace"), num(q + n + size, wide) + base))
        rows.append([path or "/", "group" if group or kind is None else "dataset", kind or "-", " × ".join(map(str, shape)) if shape else "scalar" if shape == [] else "-"])
        for name, where in links:
            visit(where, f"{path}/{name}", depth + 1)

    root = num(base + 24 + 4 * (version == 1) + 4 * wide + wide, wide) + base if version < 2 else num(base + 12 + 3 * wide, wide) + base
    try:
        visit(root, "", 0)
    except (IndexError, ValueError) as e:
        s.warnings.append(f"Parsing stopped: {e}")
    rows.sort(key=lambda r: r[0])
    s.facts = [("Superblock", version), ("Groups", sum(r[1] == "group" for r in rows)), ("Datasets", sum(r[1] == "dataset" for r in rows))]
    return s.add("Objects", ["path", "kind", "type", "shape"], rows)


@parser("hex")
def dump(data: bytes) -> Summary:
    return Summary("HEX", "Binary", [("Bytes", len(data))]).add("Hex", ["Offset", "Hex", "ASCII"], hex_lines(data, 4096))
