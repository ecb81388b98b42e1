"""Secret scans with DataFrame functions only: fixed patterns, and sliding-window entropy over candidate strings.

The fixed patterns give the base spans. The method adds spans of kind `entropy`: in
each candidate string (a run of base64 or hex characters) a window slides along,
character counts are updated by the one that enters and the one that leaves, and
runs of windows whose Shannon entropy reaches the limit of the candidate's
character class become spans. Allow-listed candidates have none; an allow-listed part
takes out the windows that it overlaps and no others, so a long string isn't cleared by
a word somewhere in it.

Defined results: a null text is empty and has no spans; positions are code points,
end exclusive; repeated rows are scanned each on its own; an empty table gives an
empty result; other columns of the input are ignored. Whole texts are scanned.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, text_of

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: These two match maximal runs, so the least length can stand in the pattern itself.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "entropy")


@dataclass(frozen=True)
class EntropyRule:
    """Windows of `window` characters; least entropy in bits for each class; patterns of candidates, and of parts of them, that are never secrets.

    Random keys of 20 characters reach these limits in about 75 (letters of one case), 95 (letters), 99
    (hexadecimal) and 92 or more (others) of 100 cases; of 32 characters, in 97 or more. Entropy can't tell all
    long words from letters of one case: at 3.55 bits English words stay out, some German compounds don't.
    """

    candidate: str = r"[A-Za-z0-9+/_=-]{20,}"
    window: int = 20
    hex_bits: float = 2.9
    one_case_bits: float = 3.55
    letters_bits: float = 3.68
    mixed_bits: float = 3.6
    allowed_parts: str | None = r"(?i)example|dummy|placeholder|xxxx|0000000|1234567|abcdefg"
    allowed: tuple[str, ...] = (
        r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
        r"^[A-Za-z]+([/_-][A-Za-z]+)+$",
        r"^[0-9_=+/-]+$",
    )


def prefix_sums(values: Column) -> Column:
    """Sums of all values before each one. Blocks of about the root of the length keep long arrays from quadratic time."""

    def summed(x: Column) -> Column:
        return F.aggregate(x, F.lit(0), lambda a, v: a + v)

    def body(v: Column) -> Column:
        step = F.greatest(F.ceil(F.sqrt(F.size(v))), F.lit(1)).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / step).cast("int")), lambda b: F.slice(v, b * step + 1, step))
        return let(blocks, lambda bs: let(F.transform(bs, summed), lambda sums: F.flatten(F.transform(
            bs, lambda x, b: let(summed(F.slice(sums, F.lit(1), b)), lambda start: F.transform(x, lambda _, i: start + summed(F.slice(x, F.lit(1), i))))
        ))))

    return F.when(F.size(values) > 0, let(values, body)).otherwise(F.array().cast("array<int>"))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, word>> of the leftmost non-overlapping matches, from the gaps between them and their lengths."""
    rx = F.lit(pattern)
    words = F.regexp_extract_all(text, rx, F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x))
    both = let(words, lambda ws: let(gaps, lambda g: let(prefix_sums(F.transform(ws, lambda w: F.char_length(w))), lambda lens: let(
        prefix_sums(F.slice(g, F.lit(1), F.size(ws))), lambda holes: F.transform(ws, lambda w, i: F.struct((F.get(holes, i) + F.get(g, i) + F.get(lens, i)).alias("start"), w.alias("word"))),
    ))))
    return F.when(text.rlike(pattern), both).otherwise(F.array().cast("array<struct<start:int,word:string>>"))


def as_spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (m["start"] + F.char_length(m["word"])).alias("end")))


def base_spans(text: Column) -> dict[str, Column]:
    long_enough = let(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda vs: F.transform(vs, lambda v: F.char_length(v) >= 12))
    found = let(long_enough, lambda ok: F.filter(matches(text, ASSIGN), lambda m, i: F.get(ok, i)))
    assign = F.when(text.rlike(ASSIGN), found).otherwise(F.array().cast("array<struct<start:int,word:string>>"))
    return {"assign": as_spans(assign, "assign"), "access": as_spans(matches(text, ACCESS), "access"), "hex": as_spans(matches(text, HEX), "hex")}


#: Stands for each character of an allow-listed part; no candidate holds it.
BLANK = "\x7f"


def blanked(word: Column, pattern: str | None) -> Column:
    """The candidate with the allow-listed parts blanked out, as long as before."""
    if pattern is None:
        return word
    holes = let(F.regexp_extract_all(word, F.lit(pattern), F.lit(0)), lambda ws: F.transform(
        F.split(word, pattern, -1), lambda g, i: F.concat(g, F.repeat(F.lit(BLANK), F.coalesce(F.char_length(F.get(ws, i)), F.lit(0))))
    ))
    return F.when(word.rlike(pattern), F.array_join(holes, "")).otherwise(word)


def hot_runs(word: Column, rule: EntropyRule) -> Column:
    """Runs of windows of the candidate at or above its class's entropy, without blanks: array<struct<s, e>>, in characters of the candidate."""
    w = rule.window
    # c * log2(c) for the counts a window can have
    table = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(w + 1)])
    limit = (
        F.when(word.rlike("^([0-9a-f]+|[0-9A-F]+)$"), rule.hex_bits)
        .when(word.rlike("^([A-Z]?[a-z]+|[A-Z]+)$"), rule.one_case_bits)
        .when(word.rlike("^[A-Za-z]+$"), rule.letters_bits)
        .otherwise(rule.mixed_bits)
    )
    codes = F.transform(F.split(blanked(word, rule.allowed_parts), "(?!^)"), lambda c: F.ascii(c) - 32)
    blank = ord(BLANK) - 32

    def slide(cs: Column, bits: Column) -> Column:
        start = F.struct(F.array_repeat(F.lit(0), 96).alias("n"), F.lit(0.0).alias("s"), F.array().cast("array<struct<s:int,e:int>>").alias("runs"), F.lit(-1).alias("from"), F.lit(-1).alias("to"))

        def step(a: Column, j: Column) -> Column:
            new = F.get(cs, j)
            old = F.when(j >= w, F.get(cs, j - w)).otherwise(F.lit(-1))
            same = new == old
            c_old, c_new = F.get(a["n"], old), F.get(a["n"], new)
            gone = F.when((old < 0) | same, 0.0).otherwise(F.get(table, c_old - 1) - F.get(table, c_old))
            come = F.when(same, 0.0).otherwise(F.get(table, c_new + 1) - F.get(table, c_new))
            n = F.when(same, a["n"]).otherwise(F.transform(a["n"], lambda c, i: c + (i == new).cast("int") - (i == old).cast("int")))
            s = a["s"] + gone + come
            hot = (j >= w - 1) & (math.log2(w) - s / w >= bits) & (F.get(n, F.lit(blank)) == 0)
            joins = a["to"] >= j - w + 1
            push = hot & ~joins & (a["to"] >= 0)
            return F.struct(
                n.alias("n"), s.alias("s"),
                F.when(push, F.concat(a["runs"], F.array(F.struct(a["from"].alias("s"), a["to"].alias("e"))))).otherwise(a["runs"]).alias("runs"),
                F.when(hot & ~joins, j - w + 1).otherwise(a["from"]).alias("from"),
                F.when(hot, j + 1).otherwise(a["to"]).alias("to"),
            )

        def finish(a: Column) -> Column:
            return F.when(a["to"] >= 0, F.concat(a["runs"], F.array(F.struct(a["from"].alias("s"), a["to"].alias("e"))))).otherwise(a["runs"])

        return F.aggregate(F.sequence(F.lit(0), F.size(cs) - 1), start, step, finish)

    return let(codes, lambda cs: let(limit, lambda bits: slide(cs, bits)))


def entropy_spans(text: Column, rule: EntropyRule) -> Column:
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def of(m: Column) -> Column:
        allowed = F.lit(False)
        for p in rule.allowed:
            allowed = allowed | m["word"].rlike(p)
        return F.when(allowed, none).otherwise(F.transform(hot_runs(m["word"], rule), lambda r: F.struct((m["start"] + r["s"]).alias("start"), F.lit(3).alias("kind"), (m["start"] + r["e"]).alias("end"))))

    return F.when(text.rlike(rule.candidate), F.flatten(F.transform(matches(text, rule.candidate), of))).otherwise(none)


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame, rule: EntropyRule = EntropyRule(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, assign, access, hex, entropy: array<struct<start, kind, end>> each."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    text = F.col("text")
    return rows.select("doc_id", *[c.alias(k) for k, c in (base_spans(text) | {"entropy": entropy_spans(text, rule)}).items()])


def found_secrets(docs: DataFrame) -> DataFrame:
    """The digest for the query."""
    base = F.concat("assign", "access", "hex")
    return scan(docs).select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.concat(base, "entropy")).alias("spans"),
    )
