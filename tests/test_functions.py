import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablescry.functions import values as V


def one(spark, column, **cells):
    df = spark.createDataFrame([tuple(cells.values())], ", ".join(f"{k} string" for k in cells))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text, want", [("12", 12), (" 1.5 ", 1.5), ("﻿.5", 0.5), ("5.", 5), ("1e3", 1000), ("-2E-1", -0.2), ("0x10", 16), ("0b11", 3), ("0o17", 15), ("-0x10", None), ("1d", None), ("NaN", None), ("Infinity", None), ("1e400", None), ("", None), (None, None), ("1_0", None), ("1 2", None), ("0", 0), ("00x1", None)])
def test_parse_numeric(spark, text, want):
    assert one(spark, V.parse_numeric(F.col("a")), a=text) == want


MS = lambda *a: int(datetime.datetime(*a, tzinfo=datetime.UTC).timestamp() * 1000)


@pytest.mark.parametrize("text, want", [("2024-01-02", MS(2024, 1, 2)), ("2024/01-02", MS(2024, 1, 2)), ("2024-02-29T10:20", MS(2024, 2, 29, 10, 20)), ("2024-01-02 10:20:30.5Z", MS(2024, 1, 2, 10, 20, 30) + 500), ("2024-01-02T00:00+05:30", MS(2024, 1, 1, 18, 30)), ("2024-01-02-0100", MS(2024, 1, 2, 1)), ("2024-01-02Z", MS(2024, 1, 2)), ("1969-12-31T23:59:59.999", -1), ("2024-02-31", None), ("2023-02-29", None), ("2024-13-01", None), ("2024-01-02T24:00", None), ("2024-01-02T10:60", None), ("2024-01-02T10:00+14:01", None), ("2024-01-02T10:00+14:00", MS(2024, 1, 1, 20)), ("2024-01-02T10:00+99:99", None), ("2024-1-2", None), ("x2024-01-02", None), ("", None), (None, None), ("2024-01-02T10:00:00.1234", None)])
def test_parse_date_key(spark, text, want):
    assert one(spark, V.parse_date_key(F.col("a")), a=text) == want


def natural(a: str):
    import re

    return [(48, len(x.lstrip("0") or "0"), x.lstrip("0") or "0") if x.isdigit() else (ord(x), 0, "") for x in re.findall(r"[0-9]+|[^0-9]", a.lower())]


@given(st.lists(st.text(alphabet="aB10 -é", max_size=6), min_size=1, max_size=12))
@settings(deadline=None, max_examples=8)
def test_natural_order(spark, words):
    df = spark.createDataFrame(list(enumerate(words)), "i int, w string")
    got = [r["w"] for r in df.orderBy(V.natural_key(F.col("w")), "i").collect()]
    assert got == [w for _, _, w in sorted((natural(w), i, w) for i, w in enumerate(words))]


def test_formats(spark):
    lit = F.lit
    row = spark.range(1).select(
        V.format_stat(lit(1.5)), V.format_stat(lit(2.0)), V.format_stat(lit(0.123456)), V.format_stat(lit(float("nan"))), V.format_percent(lit(1 / 3)), V.format_percent(lit(0.5)),
        V.format_bytes(lit(1023), "words"), V.format_bytes(lit(1536), "binary"), V.format_bytes(lit(5 << 20), "short"), V.format_count(lit(1_200_000_000)), V.format_count(lit(12_345)), V.format_count(lit(7)),
        V.truncated(lit("abcdef"), 4), V.dimensions(F.array(lit(2), lit(3))), V.xml_tag(lit("1 x")), V.xml_text(lit("<b>a &amp;lt; b</b>")), V.plain_number(lit(45727560.0)), V.plain_number(lit(0.5)), V.plain_number(lit(-0.0)),
        V.json_path(lit("$"), lit('a"b'), lit(False)), V.chart_value(lit(0.256), "0.0%"), V.chart_value(lit(1234.5), "$#,##0.00"), V.nice_step(lit(95.0)), V.wkt_name(lit('GEOGCS["WGS 84",X]')), V.number_kind(lit("0x1F")), V.number_kind(lit("1.5e3")), V.cell_type(lit("2024-01-01")),
    ).first()
    assert list(row) == ["1.5", "2", "0.1235", "—", "33.3%", "50%", "1023 bytes", "1.5 KiB", "5.00 MB", "1.20B", "12.3K", "7", "abcd… (+2 chars)", "2 × 3", "node_1_x", "a &lt; b", "45727560", "0.5", "0", '$["a\\"b"]', "25.6%", "$1,234.50", 20.0, "WGS 84", "integer", "float", "date"]


def test_doubles_print_as_through_decimals(spark):
    odd = [0.0, -0.0, 0.1, 0.001, 0.002, 0.0009999, -84197.04, 1 / 3, 123456.7890123, 9999999.5, 1e7, 1.5e7 + 0.25, 5e14 + 0.5, 1e15, 2.0**53, 1e20, 1e-10, 1e-12, -1e-12, 12345.678901, 100.0, -120.5]
    rows = spark.createDataFrame([(x,) for x in odd], "x double").select(V.plain_double(F.col("x")).alias("a"), V.plain_number(F.col("x")).alias("b")).collect()
    assert [r["a"] for r in rows] == [r["b"] for r in rows]
    assert [r["a"] for r in rows][:7] == ["0", "0", "0.1", "0.001", "0.002", "0.0009999", "-84197.04"] and rows[-1]["a"] == "-120.5" and rows[-2]["a"] == "100"


def test_geometry_and_bytes(spark):
    xs, ys = F.array(*map(F.lit, (0.0, 4.0, 4.0, 0.0))), F.array(*map(F.lit, (0.0, 0.0, 3.0, 3.0)))
    row = spark.range(1).select(V.signed_ring_area(xs, ys), V.point_in_ring(F.lit(1.0), F.lit(1.0), xs, ys), V.point_in_ring(F.lit(5.0), F.lit(1.0), xs, ys), V.base64_decode(F.lit("???")), V.base64_decode(V.base64_encode(F.lit("é"))), V.tensor_bytes(F.lit(64), F.lit(32), F.lit(18)), V.tensor_bytes(F.lit(33), F.lit(32), F.lit(18)), V.align_up(F.lit(33), F.lit(32))).first()
    assert [*row][:5] == [12.0, True, False, None, "é"] and [int(x) if x is not None else None for x in [*row][5:]] == [36, None, 64]
    dump = spark.range(1).select(F.inline(V.hex_rows(F.lit(b"0123456789abcdef\x00z")))).collect()
    assert [r["ascii"] for r in dump] == ["0123456789abcdef", ".z"] and dump[1]["offset"] == "00000010"
    assert one(spark, V.directory_prefixes(F.col("a")), a="a/b/c") == ["a/", "a/b/"] and one(spark, V.directory_prefixes(F.col("a")), a="a") == []
