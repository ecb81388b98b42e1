"""Scalar functions over text cells, as column expressions: numbers, dates, blanks, formatting, encoding, JSON paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that trimming removes, beyond ASCII: no-break space, byte order mark and the Unicode spaces.
TRIMMED = r"[\s\x0B\u00A0\uFEFF\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
#: Digits and perhaps a fraction, too short to be infinite: what most number cells are.
PLAIN = r"\A[+-]?[0-9]{1,300}(?:[.][0-9]{0,300})?\z"
#: A day that every month has, with or without a time of day; other cells may be dates too.
PLAIN_DAY = r"\A[1-9][0-9]{3}[-/](?:0[1-9]|1[0-2])[-/](?:0[1-9]|1[0-9]|2[0-8])(?:T(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:[.][0-9]{1,3})?Z?)?\z"
BASED = "^0([xX][0-9a-fA-F]+|[oO][0-7]+|[bB][01]+)$"
DECIMAL = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
#: A date cell, part by part: the day, and perhaps a time of day to the millisecond and a zone of no more than 14 hours.
DAY, SIXTY = "[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}", "[0-5][0-9]"
CLOCK = f"[T ]([01][0-9]|2[0-3]):{SIXTY}(:{SIXTY}([.][0-9]{{1,3}})?)?"
ZONE = f"Z|[+-](0[0-9]|1[0-3]):?{SIXTY}|[+-]14:?00"
DATE = f"^{DAY}({CLOCK})?({ZONE})?$"
IDENTIFIER = r"^[A-Za-z_$][A-Za-z0-9_$]*$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def trimmed(cell: Column) -> Column:
    """Without white space at the ends. All-ASCII cells, known by their lengths, take the fast built-in."""
    c = F.coalesce(cell, F.lit(""))
    return F.when(F.octet_length(c) == F.char_length(c), F.btrim(c, F.lit(" \t\n\x0b\x0c\r"))).otherwise(F.regexp_replace(c, f"^{TRIMMED}+|{TRIMMED}+$", ""))


def is_blank(cell: Column) -> Column:
    return trimmed(cell) == ""


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def parse_numeric(cell: Column) -> Column:
    """The finite number that the whole trimmed cell spells, else null: decimal, or 0x, 0o, 0b without sign."""
    return numeric(trimmed(cell))


def numeric(t: Column) -> Column:
    """parse_numeric of a cell that is trimmed already."""
    based = F.lit(None).cast("double")
    for letter, base, digits in (("xX", 16, "0-9a-fA-F"), ("oO", 8, "0-7"), ("bB", 2, "01")):
        based = F.when(t.rlike(f"^0[{letter}][{digits}]+$"), F.conv(F.substring(t, 3, 1 << 20), base, 10).try_cast("double")).otherwise(based)
    n = F.when(t.rlike(DECIMAL), t.try_cast("double")).when(F.startswith(t, F.lit("0")), based)
    return F.when(F.abs(n) < F.lit(float("inf")), n)


def is_number(t: Column) -> Column:
    """Whether a trimmed cell is a finite number, for any that numeric reads."""
    return F.when(t.rlike(DECIMAL), F.abs(t.try_cast("double")) < F.lit(float("inf"))).otherwise(t.rlike(BASED))


def calendar_day(cell: Column) -> Column:
    """The day that the first ten characters name, if there is one."""
    return F.replace(F.substring(cell, 1, 10), F.lit("/"), F.lit("-")).try_cast("date")


def is_date(cell: Column) -> Column:
    return F.when(cell.rlike(DATE), calendar_day(cell).isNotNull()).otherwise(False)


def parse_date_key(cell: Column) -> Column:
    """Milliseconds since the epoch of a date or date and time in ISO shape, else null; no zone means UTC.

    One pattern decides the shape and the ranges; the parts then stand at fixed places.
    """
    at = lambda p, n: F.substring(cell, p, n)
    number = lambda p: at(p, 2).try_cast("int")
    zero = F.lit(0)
    timed = at(11, 1).isin("T", " ")
    seconds, fraction = timed & (at(17, 1) == ":"), timed & (at(17, 1) == ":") & (at(20, 1) == ".")
    hour, minute, second = F.when(timed, number(12)).otherwise(zero), F.when(timed, number(15)).otherwise(zero), F.when(seconds, number(18)).otherwise(zero)
    millis = F.when(fraction, F.rpad(F.regexp_extract(cell, r"\.(\d+)", 1), 3, "0").try_cast("int")).otherwise(zero)
    # A sign after the day's ten characters begins the zone; four digits of it are left without the colon.
    zone = F.replace(F.regexp_extract(cell, r"[+-]\d{2}:?\d{2}$", 0), F.lit(":"), F.lit(""))
    shift = (F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 4, 2).try_cast("int")) * F.when(F.startswith(zone, F.lit("-")), -1).otherwise(1)
    offset = F.when(F.substring(cell, 11, 14).rlike("[+-]"), shift).otherwise(zero)
    clock = (((hour * 60 + minute) * 60 + second) * 1000 + millis - offset * 60_000).cast("long")
    return F.when(is_date(cell), F.unix_date(calendar_day(cell)).cast("long") * 86_400_000 + clock)


def natural_key(text: Column) -> Column:
    """A sort key that orders digit runs by value and all else by code point, case folded.

    Each run or character is (code, length, digits); digit runs take the code of '0'.
    """
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"([0-9]+|[^0-9])"), F.lit(1))

    def item(x: Column) -> Column:
        digits = F.regexp_replace(x, "^0+(?=.)", "")
        number = x.rlike("^[0-9]")
        return F.struct(F.when(number, 48).otherwise(F.ascii(x)).alias("c"), F.when(number, F.length(digits)).otherwise(0).alias("n"), F.when(number, digits).otherwise("").alias("d"))

    return F.transform(runs, item)


def plain_number(n: Column) -> Column:
    """A number the way scripts print it: no exponent below 1e21, no trailing zeros. A decimal has no negative zero."""
    return F.regexp_replace(n.cast("decimal(38,10)").cast("string"), r"(?:\.0*|(\.\d*?[1-9])0+)$", "$1")


def plain_double(n: Column) -> Column:
    """plain_number of a double. Whole numbers print as such, and those of few digits as they are; only the rest need decimals and patterns."""
    size, printed = F.abs(n), n.cast("string")
    short = (size >= 0.001) & (size < 10_000_000) & (F.octet_length(printed) <= 12) & ~F.endswith(printed, F.lit("0"))
    whole = (size < 1e15) & (n == F.rint(n))
    return F.when(whole, n.cast("long").cast("string")).when(short, printed).otherwise(plain_number(n))


def format_stat(n: Column) -> Column:
    """At most four decimals, no trailing zeros; a dash where not finite."""
    rounded = F.regexp_replace(F.regexp_replace(F.round(n, 4).cast("decimal(38,4)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(n.isNull() | F.isnan(n) | (F.abs(n) == float("inf")), "—").otherwise(rounded)


def format_percent(fraction: Column) -> Column:
    return F.concat(F.regexp_replace(F.round(fraction * 100, 1).cast("decimal(38,1)").cast("string"), r"\.0$", ""), F.lit("%"))


#: Unit names, decimals of large units, and whether whole bytes say "bytes".
BYTE_STYLES = {"words": (("bytes", "KB", "MB", "GB", "TB"), 1), "binary": (("B", "KiB", "MiB", "GiB", "TiB"), 1), "short": (("B", "KB", "MB", "GB", "TB"), 2), "loose": (("B", "KB", "MB", "GB", "TB"), 1)}


def format_bytes(n: Column, style: str = "binary") -> Column:
    units, decimals = BYTE_STYLES[style]
    out = F.concat(n.cast("long").cast("string"), F.lit(f" {units[0]}"))
    for power, unit in enumerate(units[1:], 1):
        scaled = F.format_string(f"%.{decimals}f {unit}", n / float(1024**power))
        out = F.when(n >= 1024**power, scaled).otherwise(out)
    return out


def format_count(n: Column) -> Column:
    """1.20B, 350.0M, 12.3K, or the number."""
    return (
        F.when(n >= 1_000_000_000, F.format_string("%.2fB", n / 1e9))
        .when(n >= 1_000_000, F.format_string("%.1fM", n / 1e6))
        .when(n >= 1_000, F.format_string("%.1fK", n / 1e3))
        .otherwise(n.cast("long").cast("string"))
    )


def base64_encode(text: Column) -> Column:
    return F.base64(F.encode(text, "UTF-8"))


def base64_decode(text: Column) -> Column:
    """The text, or null where the input isn't base64."""
    return F.decode(F.try_to_binary(F.trim(text), F.lit("base64")), "UTF-8")


def utf8_length(text: Column) -> Column:
    return F.octet_length(text)


def hex_rows(data: Column, width: int = 16) -> Column:
    """array<struct<offset, hex, ascii>>: a dump of the bytes in lines."""
    starts = F.when(F.octet_length(data) > 0, F.sequence(F.lit(0), F.octet_length(data) - 1, F.lit(width))).otherwise(F.array().cast("array<int>"))

    def line(at: Column) -> Column:
        part = F.substring(F.hex(data), at * 2 + 1, F.lit(2 * width))
        spaced = F.rtrim(F.regexp_replace(part, "(..)", "$1 "))
        shown = F.array_join(F.transform(F.regexp_extract_all(part, F.lit("(..)"), F.lit(1)), lambda h: F.when(h.between("20", "7E"), F.decode(F.unhex(h), "UTF-8")).otherwise(".")), "")
        return F.struct(F.lower(F.lpad(F.hex(at), 8, "0")).alias("offset"), F.lower(spaced).alias("hex"), shown.alias("ascii"))

    return F.transform(starts, line)


def xml_text(raw: Column) -> Column:
    """Text of an element: tags dropped, entities decoded, ampersand last."""
    out = F.trim(F.regexp_replace(raw, "<[^>]*>", ""))
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def xml_tag(name: Column) -> Column:
    clean = F.regexp_replace(name, "[^a-zA-Z0-9_.-]", "_")
    return F.when(clean.rlike("^[A-Za-z_]"), clean).otherwise(F.concat(F.lit("node_"), clean))


def truncated(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("… (+"), (F.length(text) - limit).cast("string"), F.lit(" chars)"))).otherwise(text)


def array_preview(items: Column, shown: int = 8) -> Column:
    """[N items] a, b, ... (+k)"""
    head = F.array_join(F.slice(items, 1, shown), ", ")
    rest = F.when(F.size(items) > shown, F.concat(F.lit(", … (+"), (F.size(items) - shown).cast("string"), F.lit(")"))).otherwise("")
    return F.concat(F.lit("["), F.size(items).cast("string"), F.lit(" items] "), head, rest)


def dimensions(shape: Column) -> Column:
    return F.when(F.size(shape) == 0, "scalar").otherwise(F.array_join(shape.cast("array<string>"), " × "))


def shape_product(shape: Column) -> Column:
    return F.aggregate(shape, F.lit(1).cast("decimal(38,0)"), lambda a, x: (a * x).cast("decimal(38,0)"))


def align_up(n: Column, to: Column) -> Column:
    return F.ceil(n / to) * to


def tensor_bytes(elements: Column, block_elements: Column, block_bytes: Column) -> Column:
    """Storage of a block-quantised tensor; null where the blocks don't come out even."""
    return F.when(elements % block_elements == 0, (elements / block_elements).cast("decimal(38,0)") * block_bytes)


def mel(hertz: Column) -> Column:
    return 2595.0 * F.log10(1 + hertz / 700.0)


def decibel(magnitude: Column) -> Column:
    return 20.0 * F.log10(F.greatest(magnitude, F.lit(1e-10)))


def cell_type(cell: Column) -> Column:
    """What a value typed into a sheet is: number, date or text."""
    return F.when(parse_numeric(cell).isNotNull(), "number").when(parse_date_key(trimmed(cell)).isNotNull(), "date").otherwise("text")


def iso_date(ts: Column) -> Column:
    """The date alone at midnight, else date and time in milliseconds."""
    return F.when(F.date_trunc("day", ts) == ts, F.date_format(ts, "yyyy-MM-dd")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


#: Literal kinds of numbers in settings files.
NUMBER_KINDS = {
    "integer": r"^[+-]?(0|[1-9](_?\d)*)$|^0x[0-9A-Fa-f](_?[0-9A-Fa-f])*$|^0o[0-7](_?[0-7])*$|^0b[01](_?[01])*$",
    "float": r"^[+-]?(\d(_?\d)*)(\.\d(_?\d)*)?([eE][+-]?\d(_?\d)*)?$|^[+-]?(inf|nan)$",
}


def number_kind(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind in ("float", "integer"):
        out = F.when(text.rlike(NUMBER_KINDS[kind]), kind).otherwise(out)
    return out


def json_path(parent: Column, key: Column, in_array: Column) -> Column:
    """parent.key, parent["odd key"] or parent[0]."""
    quoted = F.regexp_extract(F.to_json(F.struct(key.alias("k"))), r"^\{\"k\":(.*)\}$", 1)
    return F.when(in_array, F.concat(parent, F.lit("["), key, F.lit("]"))).when(key.rlike(IDENTIFIER), F.concat_ws(".", parent, key)).otherwise(F.concat(parent, F.lit("["), quoted, F.lit("]")))


def directory_prefixes(path: Column) -> Column:
    """a/, a/b/ of a/b/c."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>"))


def is_text(data: Column) -> Column:
    """No control characters but tab, line feed, form feed and carriage return."""
    return ~data.rlike(r"[\x00-\x08\x0B\x0E-\x1F]")


def occurrences(text: Column, term: Column) -> Column:
    """Non-overlapping occurrences, case folded; none of an empty term."""
    t, q = F.lower(text), F.lower(term)
    return F.when(F.length(q) > 0, ((F.length(t) - F.length(F.replace(t, q, F.lit("")))) / F.length(q)).cast("long")).otherwise(0)


def signed_ring_area(xs: Column, ys: Column) -> Column:
    """Shoelace; xs and ys close the ring themselves or not."""
    n = F.size(xs)
    cross = lambda i: F.get(xs, i) * F.get(ys, (i + 1) % n) - F.get(xs, (i + 1) % n) * F.get(ys, i)
    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), cross), F.lit(0.0), lambda a, x: a + x) / 2


def point_in_ring(x: Column, y: Column, xs: Column, ys: Column) -> Column:
    """Even-odd rule."""
    n = F.size(xs)

    def crosses(i: Column) -> Column:
        j = (i + n - 1) % n
        yi, yj = F.get(ys, i), F.get(ys, j)
        at = (F.get(xs, j) - F.get(xs, i)) * (y - yi) / (yj - yi) + F.get(xs, i)
        return ((yi > y) != (yj > y)) & (x < at)

    return F.size(F.filter(F.sequence(F.lit(0), n - 1), crosses)) % 2 == 1


def wkt_name(wkt: Column) -> Column:
    return F.regexp_extract(wkt, r'^\s*[A-Z]+\["([^"]*)"', 1)


def wkt_is_geographic(wkt: Column) -> Column:
    return wkt.rlike(r"^\s*GEOGCS\b")


def nice_step(span: Column) -> Column:
    """1, 2, 5 or 10 times a power of ten, about an eighth of the span."""
    raw = span / 8
    unit = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    times = raw / unit
    return F.when(span > 0, unit * F.when(times <= 1, 1).when(times <= 2, 2).when(times <= 5, 5).otherwise(10))


def chart_value(value: Column, pattern: str) -> Column:
    """A chart label: percent, thousands, currency and decimals by the pattern."""
    decimals = sum(c in "0#" for c in pattern.partition(".")[2])
    scaled = value * 100 if "%" in pattern else value
    body = F.format_number(scaled, decimals) if "," in pattern else F.format_string(f"%.{decimals}f", scaled.cast("double"))
    if "#" in pattern.partition(".")[2]:
        body = F.regexp_replace(F.regexp_replace(body, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.concat(F.lit("$" if "$" in pattern else ""), body, F.lit("%" if "%" in pattern else ""))
