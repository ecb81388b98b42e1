"""Text documents: Markdown outlines and blocks, LaTeX outlines, TOML and YAML trees, diagrams, fallback dumps."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .files import Summary, hex_lines, parser

HEADING = r"^(#{1,6})\s+(.+?)\s*#*\s*$"


def headings(texts: DataFrame, *, id_col: str, text_col: str, max_depth: int = 6) -> DataFrame:
    """id, level, text, heading_id, start, end of Markdown headings, with offsets in the document. Lines are exploded; offsets add up by document."""
    from pyspark.sql.window import Window

    from ..operators.sequences import line_offsets

    lines = line_offsets(texts, id_col=id_col, text_col=text_col)
    html = r"(?i)^\s*<h([1-6])[^>]*>(.*?)</h\1>\s*$"
    hit = lines.where(F.col("text").rlike(HEADING) | F.col("text").rlike(html))
    marks, level = F.regexp_extract("text", HEADING, 1), F.regexp_extract("text", html, 1)
    out = hit.select(id_col, "line", F.when(level != "", level.try_cast("int")).otherwise(F.length(marks)).alias("level"), F.when(level != "", F.regexp_extract("text", html, 2)).otherwise(F.regexp_extract("text", HEADING, 2)).alias("text"), "start", "end")
    number = F.row_number().over(Window.partitionBy(id_col).orderBy("line")) - 1
    return out.where(F.col("level") <= max_depth).withColumn("heading_id", F.concat(F.lit("heading-"), number.cast("string"))).drop("line")


def block_kinds(text: str) -> list[tuple[int, str]]:
    """(line, kind) of top-level Markdown blocks: heading, code, quote, list, table, rule, paragraph, opaque."""
    out: list[list] = []
    fence, now, box = "", None, None

    def kind_of(line: str) -> str:
        for kind, rx in (("heading", r" {0,3}#{1,6}(\s|$)"), ("quote", r" {0,3}>"), ("rule", r" {0,3}([-*_])\s*(\1\s*){2,}$"), ("list", r" {0,3}([-+*]|\d{1,9}[.)])\s"), ("opaque", r" {0,3}<[A-Za-z!/?]"), ("code", r"( {4}|\t)")):
            if re.match(rx, line):
                return kind
        return "paragraph"

    for i, line in enumerate(text.split("\n")):
        if fence:
            if re.match(rf" {{0,3}}{re.escape(fence[0])}{{{len(fence)},}}\s*$", line):
                fence = ""
            continue
        if not line.strip():
            now = None
            continue
        if m := re.match(r" {0,3}(`{3,}|~{3,})", line):
            fence, now = m[1], None
            out.append([i + 1, "code"])
            continue
        kind = kind_of(line)
        if now:
            if now[1] == "paragraph" and re.match(r" {0,3}(=+|-+)\s*$", line):
                now[1], now = "heading", None
                continue
            if now[1] == "paragraph" and i == now[0] and "-" in line and re.match(r"\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$", line):
                now[1] = "table"
                continue
            if kind in ("paragraph", "code") or kind == now[1]:
                continue
        elif box and re.match(r"( {2,}|\t)\S", line):
            continue
        now = [i + 1, kind]
        out.append(now)
        box = kind if kind in ("list", "quote") else None
        if kind in ("heading", "rule"):
            now = None
    return [(n, k) for n, k in out]


@parser("latex", "tex")
def latex(data: bytes) -> Summary:
    """Class, packages, macros, outline, labels, references, citations, theorems and tables."""
    source = re.sub(r"(?m)(^|[^\\])%.*$", r"\1", data.decode("utf-8", "replace"))
    kind = re.search(r"\\documentclass\s*(?:\[([^\]]*)\])?\s*\{([^}]+)\}", source)
    s = Summary("LATEX", "LaTeX document", [("Class", kind[2] if kind else "-"), ("Options", (kind[1] if kind else "") or "-")])
    if not kind:
        s.warnings.append("No \\documentclass: not a LaTeX document.")
    line_of = lambda m: source.count("\n", 0, m.start()) + 1
    #: Sectioning commands by level.
    levels = {"part": 0, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5, "subparagraph": 6}
    braces = r"\{((?:[^{}]|\{[^{}]*\})*)\}"
    s.add("Outline", ["Level", "Command", "Title", "Line"], [[levels[m[1]], m[1], m[3], line_of(m)] for m in re.finditer(rf"\\({'|'.join(levels)})(\*?)\s*(?:\[[^\]]*\])?\s*{braces}", source)])
    s.add("Packages", ["Package", "Options"], [[p.strip(), m[1] or "-"] for m in re.finditer(r"\\usepackage\s*(?:\[([^\]]*)\])?\s*\{([^}]+)\}", source) for p in m[2].split(",")])
    s.add("Macros", ["Name", "Arguments", "Body"], [[m[1], m[2] or "0", m[3]] for m in re.finditer(rf"\\(?:re)?newcommand\*?\s*\{{?(\\[A-Za-z]+)\}}?\s*(?:\[(\d)\])?(?:\[[^\]]*\])?\s*{braces}", source)])
    labels = [[m[1], line_of(m)] for m in re.finditer(r"\\label\{([^}]+)\}", source)]
    refs = [[m[1], r.strip(), line_of(m)] for m in re.finditer(r"\\(ref|eqref|autoref|cref|pageref|cite[tp]?)\*?(?:\[[^\]]*\])*\{([^}]+)\}", source) for r in m[2].split(",")]
    known = {x[0] for x in labels}
    s.warnings += [f"Undefined reference: {r}" for c, r, _ in refs if not c.startswith("cite") and r not in known]
    s.add("Labels", ["Label", "Line"], labels).add("References", ["Command", "Label", "Line"], refs)
    s.add("Theorems", ["Environment", "Title", "Line"], [[m[1], m[2] or "-", line_of(m)] for m in re.finditer(r"\\begin\{(theorem|lemma|corollary|proposition|definition|remark|example|proof)\}(?:\[([^\]]*)\])?", source)])
    rows = [[t, i, j, c.strip()] for t, m in enumerate(re.finditer(r"(?s)\\begin\{tabular\}\s*(?:\[[^\]]*\])?\{[^}]*\}(.*?)\\end\{tabular\}", source)) for i, r in enumerate(x for x in re.split(r"\\\\", re.sub(r"\\(hline|toprule|midrule|bottomrule)", "", m[1])) if x.strip()) for j, c in enumerate(re.split(r"(?<!\\)&", r))]
    s.add("Tables", ["Table", "Row", "Column", "Cell"], rows)
    return s.add("Includes", ["Command", "Path", "Line"], [[m[1], m[2].strip(), line_of(m)] for m in re.finditer(r"\\(input|include)\{([^}]+)\}", source)])


def tree_rows(value, kind_of) -> list[list]:
    rows: list[list] = []

    def walk(v, key: str, path: str, depth: int) -> None:
        kind = kind_of(v)
        rows.append([len(rows), key, path, kind, depth, "" if isinstance(v, (dict, list)) else ("true" if v is True else "false" if v is False else str(v))])
        for k, x in v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ():
            walk(x, str(k), f"{path}[{k}]" if isinstance(v, list) else f"{path}.{k}".lstrip("."), depth + 1)

    walk(value, "$", "", 0)
    return rows


NODE_HEADS = ["node_id", "key", "path", "kind", "depth", "value"]


@parser("toml")
def toml(data: bytes) -> Summary:
    import datetime
    import tomllib

    s = Summary("TOML", "TOML document")

    def kind(v) -> str:
        names = ((bool, "boolean"), (int, "integer"), (float, "float"), (str, "string"), (dict, "table"), (list, "array"))
        return "datetime" if isinstance(v, (datetime.date, datetime.time)) else next(n for t, n in names if isinstance(v, t))

    try:
        rows = tree_rows(tomllib.loads(data.decode("utf-8-sig", "replace").replace("\r\n", "\n")), kind)
    except tomllib.TOMLDecodeError as e:
        s.warnings.append(f"toml.invalid: {e}")
        rows = []
    s.facts = [("Nodes", len(rows)), ("Max depth", max([0, *(r[4] for r in rows)]))]
    return s.add("Nodes", NODE_HEADS, rows)


@parser("yaml", "yml")
def yaml_tree(data: bytes) -> Summary:
    """Needs a YAML library on the workers; without one the file is reported, not read."""
    s = Summary("YAML", "YAML documents")
    try:
        import yaml
    except ImportError:
        s.warnings.append("yaml.no-parser: no YAML library is installed.")
        return s
    kind = lambda v: "map" if isinstance(v, dict) else "seq" if isinstance(v, list) else "scalar"
    for i, doc in enumerate(yaml.safe_load_all(data.decode("utf-8", "replace"))):
        s.add(f"Document {i + 1}", NODE_HEADS, tree_rows(doc, kind))
    s.facts = [("Documents", len(s.tables))]
    return s


@parser("mermaid", "plantuml")
def diagram(data: bytes) -> Summary:
    source = data[:200_000].decode("utf-8", "replace")
    s = Summary("DIAGRAM", "Diagram source", [("Characters", len(source)), ("First line", next((x.strip() for x in source.splitlines() if x.strip()), "-"))])
    if len(data) > 200_000:
        s.warnings.append("Source is limited to the first 200000 bytes.")
    if "@startuml" in source and "@enduml" not in source:
        s.warnings.append("The diagram has no end mark.")
    return s


def diagram_kind(source: Column) -> Column:
    """flowchart, sequence, ... of Mermaid source, or plantuml."""
    return F.when(source.rlike(r"(?m)^\s*@startuml"), "plantuml").otherwise(F.regexp_extract(F.substring(source, 1, 200_000), r"(?m)^\s*(graph|flowchart|sequenceDiagram|classDiagram|stateDiagram|erDiagram|gantt|pie|journey)\b", 1))


@parser("fallback")
def fallback(data: bytes) -> Summary:
    """Text if there are no control characters in its beginning, else a hex dump."""
    head = data[: 256 << 10]
    try:
        text = head.decode("utf-8") if len(data) == len(head) else head.decode("utf-8", "ignore")
        if not re.search(r"[\x00-\x08\x0b\x0e-\x1f]", text):
            return Summary("TEXT", "Text", [("Characters", len(text))]).add("Lines", ["line", "text"], [[i, x] for i, x in enumerate(text.split("\n"), 1)])
    except UnicodeDecodeError:
        pass
    return Summary("HEX", "Binary", [("Bytes", len(data))]).add("Hex", ["Offset", "Hex", "ASCII"], hex_lines(data, 4096))
