import io
import json
import sqlite3
import struct
import tarfile
import zipfile
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablescry.sources import binary, delimited, detect, documents, engineering, files, jsontext, office

TEXT = st.text(alphabet='ab,"\n\r\t;é', max_size=6)


@given(st.lists(st.lists(TEXT, min_size=2, max_size=4), min_size=1, max_size=5))
@settings(deadline=None)
def test_delimited_round_trip(rows):
    rows = [[c.replace("\r", "") for c in r] for r in rows]
    text = "\n".join(delimited.header_line(tuple(r)) for r in rows) + "\n"
    assert delimited.records(text) == rows


def test_delimited_shapes():
    assert delimited.records("") == []
    assert delimited.records("\ufeffa,b\r\n1,2\r3,4\n") == [["a", "b"], ["1", "2"], ["3", "4"]]
    assert delimited.records('a,"b ""c""\nd",e\nf') == [["a", 'b "c"\nd', "e"], ["f"]]
    assert delimited.records("a,\n") == [["a", ""]]


def test_delimiter_detection():
    assert delimited.detect_delimiter("a,b\nc,d\ne,f\ng,h\ni|j\n")[0] == ","
    assert delimited.detect_delimiter('a;b\n"x;y;z";2\n')[0] == ";"
    assert delimited.detect_delimiter("one\ntwo\n") == (",", 0.0)


def test_read_ragged(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b,c\n1,2\n1,2,3,4\n")
    t = delimited.read(spark, str(tmp_path / "t.csv"), delimiter=",")
    assert t.headers == ("a", "b", "c", "Column 4") and t.report["ragged"] == 2
    assert [r["cells"] for r in t.rows.orderBy("row_id").collect()] == [["1", "2", "", ""], ["1", "2", "3", "4"]]
    plain = delimited.read(spark, str(tmp_path / "t.csv"), has_header=False)
    assert plain.headers[0] == "Column 1" and plain.rows.count() == 3
    delimited.write(t, str(tmp_path / "out"))
    again = delimited.read(spark, str(tmp_path / "out"), delimiter=",")
    assert again.headers == t.headers


def test_large_files_are_reported(spark, tmp_path):
    from tablescry.plans.contracts import Limits
    from tablescry.sources import inspect

    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    (tmp_path / "b.csv").write_text("a,b\n" + "3,4\n" * 50)
    t = delimited.read(spark, str(tmp_path), delimiter=",", limits=Limits(max_bytes=100))
    assert t.rows.count() == 1 and t.report["report"].status == "partial"
    note = t.report["report"].diagnostics[0]
    assert (note.code, note.args["files"], note.location.rpartition("/")[2]) == ("limit-bytes", "1", "b.csv")
    whole = delimited.read(spark, str(tmp_path), delimiter=",")
    assert whole.rows.count() == 51 and whole.report["report"].status == "ok"
    for out in (inspect.summaries(spark, str(tmp_path), max_bytes=100), files.summarise(spark, str(tmp_path), "fallback", max_bytes=100)):
        said = {(r["path"].rpartition("/")[2], r["value"]) for r in out.where("format = 'skipped'").collect()}
        assert said == {("b.csv", "not read: 204 bytes, limit 100")}
        assert out.where("format != 'skipped'").select("path").distinct().count() == 1


JSON = st.recursive(st.none() | st.booleans() | st.integers(-(10**20), 10**20) | st.text(max_size=4), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=8)


@given(JSON)
@settings(deadline=None)
def test_json_round_trip(value):
    root, status, _, _ = jsontext.parsed(json.dumps(value))
    assert status == "ok"
    assert json.loads(jsontext.serialized(root)) == value
    assert json.loads(jsontext.serialized(root, True)) == value


def test_json_fidelity():
    root, status, code, _ = jsontext.parsed('{"a":12345678901234567890.10,"b":1e400,"a":"\\u00e9"}')
    assert (status, code) == ("ok", "duplicate-key")
    assert jsontext.serialized(root) == '{"a":12345678901234567890.10,"b":1e400,"a":"é"}'
    assert jsontext.plain(root)["a"] == "é"
    assert [r[5] for r in jsontext.walk(jsontext.parsed('{"odd key":[0,1],"a":{"b":1}}')[0])] == ["$", '$["odd key"]', '$["odd key"][0]', '$["odd key"][1]', "$.a", "$.a.b"]
    for bad, want in (('{"a":1', "partial"), ("[1,]", "partial"), ("tru", "failed"), ('"\\x"', "failed"), ("1 2", "partial"), ("[" * 501, "partial"), ("", "failed")):
        assert jsontext.parsed(bad)[1] == want, bad


def test_json_tools():
    v = {"a": [1, {"b": None}], "c d": 'x,"y"', "e": {}, "f": []}
    assert jsontext.to_csv([{"a": 1}, {"b": "x\ny", "a": None}]) == 'a,b\n1,\n,"x\ny"'
    assert jsontext.to_csv([1]) is None
    assert "<c_d>x,&quot;y&quot;</c_d>" in jsontext.to_xml(v) and "<node_1>" in jsontext.to_xml({"1": 2})
    assert jsontext.to_yaml(v) == 'a:\n  - 1\n  - b: null\nc d: "x,\\"y\\""\ne:\n  {}\nf:\n  []'
    assert jsontext.unescape_text("a\\n\\u00e9\\x41") == (True, "a\néA", "")
    assert [jsontext.unescape_text(t)[2] for t in ("a\\", "\\u12", "\\xg1")] == ["trailing", "invalid-unicode", "invalid-hex"]
    assert jsontext.escape_text('a"\n') == 'a\\"\\n'
    assert "".join(t for _, t, _ in jsontext.tokens('{"a": [1, tru?]}')) == '{"a": [1, tru?]}'
    assert jsontext.tokens('{"a": 1}')[1][0] == "key"


def test_json_lines(spark):
    df = spark.createDataFrame([(1, '{"a":1}\r\n\n{bad\n[2]')], "id long, t string")
    out = jsontext.lines(df, id_col="id", text_col="t").orderBy("line").collect()
    assert [(r["raw"], r["ending"], r["valid"]) for r in out] == [('{"a":1}', "\r\n", True), ("", "\n", True), ("{bad", "\n", False), ("[2]", "", True)]


def test_sniff():
    assert jsontext.sniff('{"a":1}\n{"b":2}') == "jsonl"
    assert jsontext.sniff(' {"a":\n1}') == "json"
    assert jsontext.sniff('syntax = "proto3";\nmessage A {}') == "proto"
    assert jsontext.sniff("\\documentclass{article}") == "latex"
    assert jsontext.sniff("% \\documentclass{x}\nplain") is None


def test_dbc():
    text = 'VERSION "1"\nBU_: A B\nSG_ early : 0|8@1+ (1,0) [0|0] "" A\nBO_ 100 Msg: 8 A\n SG_ Speed : 0|16@1+ (0.1,0) [0|100] "km/h" B\nBO_ 2147483749 Ext: 8 B\nCM_ BO_ 100 "hi \\"x\\"";\nVAL_ 100 Speed 0 "off" 1 "on";\n'
    s = engineering.dbc(text.encode())
    assert s.tables["Messages"][1] == [["0x64", "Msg", 8, "A", 1, 'hi "x"'], ["0x65", "Ext", 8, "B", 0, "-"]]
    assert s.tables["Values"][1] == [["Msg", "Speed", 0, "off"], ["Msg", "Speed", 1, "on"]] and len(s.warnings) == 1


def test_logs_and_captures():
    s = engineering.asc(b"date x\n0.1 1 123 Rx d 2 01 02\n0.2 CANFD 1 Rx 1F4 Name 1 0 8 2 AA BB\n0.3 CANFD 1 Tx 1F4 1 0 8 1 CC\n")
    assert [e[6] for e in s.tables["CAN events"][1]] == ["01 02", "AA BB", "CC"]
    packet = struct.pack("<4I", 5, 7, 3, 3) + b"abc"
    s = engineering.pcap(b"\xd4\xc3\xb2\xa1" + b"\0" * 16 + struct.pack("<I", 1) + packet + packet[:10])
    assert s.tables["Packets"][1][0][:4] == [1, "5.000007", 3, 3]
    shb = lambda o, bom: struct.pack(o + "II", 0x0A0D0D0A, 28) + bom + b"\0" * 12 + struct.pack(o + "I", 28)
    epb = lambda o: struct.pack(o + "7I", 6, 36, 0, 0, 0, 2, 2) + b"hi\0\0" + struct.pack(o + "I", 36)
    s = engineering.pcapng(shb("<", b"\x4d\x3c\x2b\x1a") + epb("<") + shb(">", b"\x1a\x2b\x3c\x4d") + epb(">"))
    assert [r[2] for r in s.tables["Packets"][1]] == [2, 2] and not s.warnings
    assert engineering.a2l(b"/begin MEASUREMENT x\n/end\n/begin GROUP").warnings
    assert engineering.step(b"#1 = POINT(1);\n#2=LINE(#1);#3=POINT(2);").tables["Top entity types"][1] == [["POINT", 2], ["LINE", 1]]
    assert engineering.blf(b"LOGG" + b"\0" * 200).warnings == [] and engineering.mf4(b"MDF     4.10    prog    ##HD##DT").tables["MDF block markers"][1] == [["##HD", 1], ["##DT", 1]]
    s = engineering.arxml(b'<AUTOSAR xmlns="u"><AR-PACKAGE><SHORT-NAME>P&amp;Q</SHORT-NAME><I-SIGNAL-REF DEST="I-SIGNAL">/a/b</I-SIGNAL-REF></AR-PACKAGE></AUTOSAR>')
    assert s.tables["Packages"][1] == [[1, "P&Q"]] and s.tables["References"][1] == [["I-SIGNAL-REF", "I-SIGNAL", "/a/b"]]
    meta = b"Obj\x01" + b"\x02" + b"\x14avro.codec" + b"\x0edeflate" + b"\x00" + b"s" * 16
    assert engineering.avro(meta).tables["Metadata"][1] == [["avro.codec", "deflate"]]


def test_proto():
    s = engineering.proto(b'syntax = "proto3";\npackage p;\nimport "x.proto";\nmessage A {\n  string n = 1; // c\n  repeated B b = 2;\n  Missing m = 2;\n  oneof o {\n    int32 k = 4;\n  }\n  enum E { }\n  message B { }\n}\nservice S {\n  rpc Go (A) returns (stream B);\n}\n')
    assert [t[0] for t in s.tables["Types"][1]] == ["p.A", "p.A.E", "p.A.B", "p.S"]
    assert [f[1] for f in s.tables["Fields"][1]] == ["n", "b", "m", "k"] and s.tables["Fields"][1][3][5] == "o"
    assert len(s.warnings) == 2 and engineering.example_message(s, "p.A")["n"] == ""


def test_tables_of_bytes():
    head = struct.pack("<B3xIHH20x", 3, 2, 32 + 64 + 1, 1 + 5 + 3)
    field = lambda n, k, w: n.encode().ljust(11, b"\0") + k.encode() + b"\0" * 4 + bytes([w]) + b"\0" * 15
    data = head + field("NAME", "C", 5) + field("POP", "N", 3) + b"\r" + b" Paris 42" + b"*Gone   1" + b" Rome    " + b"\x1a"
    assert binary.dbf(data).tables["Records"][1] == [["Paris", 42.0], ["Rome", None]]
    con = sqlite3.connect(":memory:")
    con.execute("create table topics(name text, n int)")
    con.execute("insert into topics values ('x', null)")
    con.commit()
    s = binary.db3(con.serialize())
    assert s.tables["topics"] == (["name", "n"], [["x", "NULL"]])
    meta = json.dumps({"__metadata__": {"k": "v"}, "b": {"dtype": "F32", "shape": [3], "data_offsets": [24, 36]}, "w": {"dtype": "F32", "shape": [2, 3], "data_offsets": [0, 24]}}).encode()
    s = binary.safetensors(struct.pack("<Q", len(meta)) + meta, 8 + len(meta) + 36)
    assert [t[0] for t in s.tables["Tensors"][1]] == ["w", "b"] and s.facts[1][1] == 9 and not s.warnings
    assert binary.safetensors(struct.pack("<Q", len(meta)) + meta, 8 + len(meta) + 40).warnings
    key = lambda t: struct.pack("<Q", len(t)) + t
    g = b"GGUF" + struct.pack("<IQQ", 3, 1, 1) + key(b"general.architecture") + struct.pack("<I", 8) + key(b"llama") + key(b"t") + struct.pack("<IQIQ", 1, 32, 8, 0)
    g += b"\0" * (-len(g) % 32) + b"\0" * 34
    s = binary.gguf(g)
    assert s.tables["Tensors"][1] == [["t", "Q8_0", "32", 32, 0, 34]] and not s.warnings


def test_shapes_with_holes():
    square = lambda a, b, turn: [[a, a], [a, b], [b, b], [b, a]][:: 1 if turn else -1]
    outer, inner, hole, lost = square(0, 10, True), square(2, 6, True), square(3, 4, False), square(20, 21, False)
    got = binary.polygons([outer, inner, hole, lost])
    assert got[1] == [inner, hole] and got[0] == [outer] and binary.ring_area(got[2][0]) < 0
    ring = [*outer, outer[0]]
    body = struct.pack("<i4d2i", 5, 0, 0, 10, 10, 1, 5) + struct.pack("<i", 0) + b"".join(struct.pack("<2d", *p) for p in ring)
    data = struct.pack(">i5ii", 9994, 0, 0, 0, 0, 0, 0) + struct.pack("<2i8d", 1000, 5, 0, 0, 10, 10, 0, 0, 0, 0) + struct.pack(">2i", 1, len(body) // 2) + body
    assert binary.shapefile(data).tables["Features"][1][0][1] == "Polygon"


def test_sound_pictures_archives():
    import numpy as np

    x = np.sin(np.arange(1000) / 20).reshape(-1, 2)
    data = binary.wav_encode(x, 8000)
    assert binary.wav_header(data)["frames"] == 500 and np.abs(binary.wav_samples(data, 10, 5) - x[10:15]).max() < 1e-3
    frame = b"\xff\xfb\x90\x00" + b"\0" * 413
    assert [f[1] for f in binary.mp3_frames(b"ID3\x03\0\0\0\0\0\x02xx" + frame * 3)] == [417] * 3
    assert binary.image_type(b"RIFF1234WEBP") == "image/webp" and binary.image_type(b"<svg/>") == "image/svg+xml" and binary.image_type(b"??") is None
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("xl/a.txt", "hello")
    assert binary.zip_declared(z.getvalue()) == (5, 1) and binary.zip_declared(b"PK")[0] == float("inf")
    assert binary.archive(z.getvalue()).tables["Entries"][1][0][1] == "xl/a.txt" and detect.probe(z.getvalue()) == "excel"
    t = io.BytesIO()
    with tarfile.open(fileobj=t, mode="w:gz") as f:
        f.addfile(tarfile.TarInfo("d/x"), io.BytesIO())
    assert binary.archive(t.getvalue()).tables["Entries"][1][0][1] == "d/x"


def test_scientific():
    var = struct.pack("<II", 6, 8) + struct.pack("<II", 6, 0) + struct.pack("<II", 5, 8) + struct.pack("<2i", 2, 3) + struct.pack("<HH", 1, 1) + b"x\0\0\0"
    element = struct.pack("<II", 14, len(var)) + var
    packed = zlib.compress(element)
    data = b"MATLAB".ljust(124) + struct.pack("<H", 0x100) + b"IM" + element + struct.pack("<II", 15, len(packed)) + packed
    assert [r[:3] for r in binary.mat(data).tables["Variables"][1]] == [["x", "double", "2 × 3"]] * 2
    four = struct.pack("<5I", 0, 1, 2, 0, 2) + b"a\0" + b"\0" * 16
    assert binary.mat(four).tables["Variables"][1] == [["a", "double", "1 × 2", "real"]]
    assert binary.hdf5(b"nothing").warnings
    field = lambda n, b: bytes([n << 3 | 2, len(b)]) + b
    node = field(1, b"x") + field(2, b"y") + field(4, b"Relu")
    tensor = b"\x08\x02\x08\x03\x10\x01" + field(8, b"w")
    s = binary.onnx(b"\x08\x08" + field(7, field(1, node) + field(5, tensor) + field(11, field(1, b"x"))) + field(8, b"\x10\x11"))
    assert s.tables["Nodes"][1][0][3] == "Relu" and s.tables["Initializers"][1][0][1:5] == ["w", "float", "2 × 3", "6"] and s.tables["Opsets"][1] == [["ai.onnx", 17]]


def test_documents():
    assert documents.block_kinds("# a\n\ntext\n---\n\n- x\n\n  more\n\n> q\n```\n# no\n```\na|b\n-|-\n***\n") == [(1, "heading"), (3, "heading"), (6, "list"), (10, "quote"), (11, "code"), (14, "table"), (16, "rule")]
    s = documents.latex(b"\\documentclass[a4]{book}\n\\newcommand{\\x}[1]{b}\n\\section{One}\\label{s} \\ref{t}\n\\begin{tabular}{ll}a&b\\\\c&d\\end{tabular}")
    assert s.tables["Outline"][1] == [[2, "section", "One", 3]] and s.warnings == ["Undefined reference: t"] and len(s.tables["Tables"][1]) == 4
    assert documents.toml(b"a = 1\n[b]\nc = [true, 2.5]\n").tables["Nodes"][1][2][:4] == [2, "b", "b", "table"]
    assert documents.toml(b"a = 1\na = 2").warnings
    assert documents.fallback(b"hi\nyou").tables["Lines"][1] == [[1, "hi"], [2, "you"]] and documents.fallback(b"\0\1").format == "HEX"


def test_office(spark, tmp_path):
    from tablescry.operators import cells

    data = office.write_workbook({"S": [["name", "n"], ["a & b", 1.5], [True, None]]})
    sheets, _ = office.workbook(data)
    assert sheets[0]["cells"] == [(0, 0, "text", "name", "name"), (0, 1, "text", "n", "n"), (1, 0, "text", "a & b", "a & b"), (1, 1, "number", "1.5", "1.5"), (2, 0, "boolean", "1", "TRUE")]
    assert office.iso(45292.5, False) == "2024-01-01T12:00:00.000Z" and office.iso(45292, False) == "2024-01-01"
    (tmp_path / "a.xlsx").write_bytes(data)
    long = files.summarise(spark, str(tmp_path), "xlsx")
    c = files.table(long, "Cells", ["sheet", "r", "c", "t", "v", "w"]).selectExpr("int(r) r", "int(c) c", "w")
    t = cells.dense(c, has_header=True)
    assert t.headers == ("name", "n") and [r["cells"] for r in t.rows.orderBy("row_id").collect()] == [["a & b", "1.5"], ["TRUE", ""]]
    assert files.matching(long, "a & b").count() == 6
    (tmp_path / "a.xlsx").write_bytes(b"junk")
    assert files.summarise(spark, str(tmp_path), "xlsx").where("table = '(warnings)'").count() == 1
    chart = b'<c xmlns="u"><ser><tx><pt idx="0"><v>S1</v></pt></tx><cat><pt idx="0"><v>A</v></pt></cat><val><pt idx="0"><v>3</v></pt></val></ser></c>'
    assert office.chart_points(chart) == [["A", "S1", 3.0, 0]]


@pytest.mark.parametrize("name, head, text, want", [("x.tar.gz", b"\x1f\x8b", None, ("archive", "extension")), ("x.XLSX", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", None, ("fallback", "ambiguous-container")), ("noext", b"{}", '{"a":1}', ("json", "content")), ("noext", b"GGUF", None, ("gguf", "content")), ("a.png", b"BMxx", None, ("image", "extension")), ("a.gguf", b"nope", None, ("fallback", "fallback")), ("a.svg", b"<svg", None, ("image", "extension"))])
def test_detection(spark, name, head, text, want):
    df = spark.createDataFrame([(name, bytearray(head), text)], "name string, head binary, text string")
    r = detect.detect(df, head="head", text="text").first()
    assert (r["format"], r["matched_by"]) == want


def test_inspect_folder(spark, tmp_path):
    from tablescry.sources import inspect

    (tmp_path / "a.toml").write_text("x = 1\n")
    (tmp_path / "b").write_bytes(office.write_workbook({"S": [["v", 1]]}))
    (tmp_path / "c.bin").write_bytes(b"\0\1\2")
    (tmp_path / "d.unknown").write_text('{"a": 1}')
    (tmp_path / "e.dbf").write_bytes(b"short")
    kinds = {r["name"]: (r["format"], r["matched_by"]) for r in inspect.formats(spark, str(tmp_path)).collect()}
    assert kinds == {"a.toml": ("toml", "extension"), "b": ("fallback", "ambiguous-container"), "c.bin": ("fallback", "fallback"), "d.unknown": ("json", "content"), "e.dbf": ("fallback", "fallback")}
    out = inspect.summaries(spark, str(tmp_path)).cache()
    by = {r["path"].rpartition("/")[2]: r["format"] for r in out.select("path", "format").distinct().collect()}
    assert by == {"a.toml": "TOML", "b": "EXCEL", "c.bin": "HEX", "d.unknown": "TEXT", "e.dbf": "TEXT"}
