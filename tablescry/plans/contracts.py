"""Limits, statuses and diagnostics as data."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: Fixed defaults: bytes, entries and seconds that one parse may take; previews are options, not defaults.
MAX_BYTES, MAX_ENTRIES, MAX_SECONDS = 256 << 20, 1_000_000, 30
TEXT_PREVIEW, BINARY_PREVIEW, ROW_PREVIEW = 4 << 20, 8 << 20, 5_000
CLIPBOARD_BYTES = 1 << 20


@dataclass(frozen=True)
class Limits:
    max_bytes: int = MAX_BYTES
    max_entries: int = MAX_ENTRIES


@dataclass(frozen=True)
class Diagnostic:
    severity: str
    code: str
    args: dict = field(default_factory=dict)
    location: str = ""


@dataclass
class Report:
    """ok, partial (a limit or a recovered error) or failed, with what was noticed."""

    source: str = ""
    diagnostics: list[Diagnostic] = field(default_factory=list)
    produced: bool = True

    def note(self, severity: str, code: str, location: str = "", **args) -> None:
        self.diagnostics.append(Diagnostic(severity, code, {k: str(v) for k, v in args.items()}, location))

    @property
    def status(self) -> str:
        if not self.produced or any(d.code in ("aborted", "input-too-large", "password-required") for d in self.diagnostics):
            return "failed"
        return "partial" if any(d.severity == "error" or d.code.startswith("limit-") for d in self.diagnostics) else "ok"

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(self.source, d.severity, d.code, d.args, d.location) for d in self.diagnostics]
        return spark.createDataFrame(rows, "source string, severity string, code string, args map<string,string>, location string")


def probed(df: DataFrame, limits: Limits, report: Report) -> DataFrame:
    """At most max_entries rows; a limit hit becomes a diagnostic. Looks one row further than the limit and no more."""
    if df.limit(limits.max_entries + 1).count() > limits.max_entries:
        report.note("warning", "limit-entries", limit=limits.max_entries)
        return df.limit(limits.max_entries)
    return df


def fits_clipboard(text: str) -> bool:
    return len(text.encode()) <= CLIPBOARD_BYTES
