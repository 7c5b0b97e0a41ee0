"""Sensitive-data detection by rules (pattern, validator, pages), redaction, and the check that nothing survives it.

Digits in patterns are 0-9. A rule sees each text once, left to right, matches not overlapping; a match that fails its
validator is no finding, and nothing within it is looked for again.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import validators as v
from pagemill.operators.objects import settled

# The patterns that define each kind of finding.
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
PHONE = r"\b(?:\(\d{3}\)\s?|\d{3}[-.])\d{3}[-.]\d{4}\b"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
ICD10_CATEGORY = r"(?:[A-TV-Z][0-9][0-9]|C4A|C7[AB]|D3A|M1A|Z3A)"
ICD10_PREFIX = rf"\b{ICD10_CATEGORY}(?:\.[0-9A-Z]{{1,4}})?\b"
ICD10_CODE = rf"\b{ICD10_CATEGORY}\.[0-9A-Z]{{1,4}}\b"
ICD10_LABEL = r"\b(?i:icd(?:[ -]?10)?(?:[ -]?cm)?|dx|diagnosis)\b[ \t]*[:#]?[ \t]*(?:(?i:code)\b[ \t]*[:#]?[ \t]*)?"
CARD = r"\b(?:\d[ -]?){13,19}\b"
ISO_DATE = r"\b\d{4}[-/]\d{2}[-/]\d{2}\b"
ZIP = r"\b\d{5}(?:-\d{4})?\b"
NHS = r"\b\d{3}\s?\d{3}\s?\d{4}\b"
PAN = r"\b[A-Z]{5}[0-9]{4}[A-Z]\b"
AADHAAR = r"\b[2-9]\d{3}\s?\d{4}\s?\d{4}\b"
IBAN = r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b"
ABA = r"\b\d{9}\b"
SWIFT_LABEL = r"\b(?i:bic|swift)\b(?:[ -]?(?i:code)\b)?[ \t]*[:#]?[ \t]*"
SWIFT = r"[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b"
EIN = r"\b\d{2}-\d{7}\b"
ITIN = r"\b9\d{2}-\d{2}-\d{4}\b"
NPI = r"\b\d{10}\b"
IPV4 = r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"


@dataclass(frozen=True)
class Rule:
    """name: what findings are called. pages: zero-based page numbers it applies to, or None for all.

    label: a pattern in front that is no part of the finding. alone: what a value must fulfil that has no label in front;
    without it, there must be one. Patterns have no groups of their own that capture.
    """

    name: str
    pattern: str
    validator: Callable[[Column], Column] | None = None
    pages: tuple[int, ...] | None = None
    ignore_case: bool = False
    label: str = ""
    alone: Callable[[Column], Column] | None = None

    @property
    def regex(self) -> str:
        pattern = self.pattern
        if self.label:
            pattern = rf"({self.label})({pattern})" if self.alone is None else rf"({self.label})?\b({pattern})"
        return f"(?i){pattern}" if self.ignore_case else pattern

    def matches(self, text: Column) -> Column:
        """All matches in order, as array<struct<label, value>>; null for a null text."""
        p = F.lit(self.regex)
        if not self.label:
            return F.transform(F.regexp_extract_all(text, p, F.lit(0)), lambda m: F.struct(F.lit("").alias("label"), m.alias("value")))
        return F.zip_with(F.regexp_extract_all(text, p, F.lit(1)), F.regexp_extract_all(text, p, F.lit(2)), lambda a, b: F.struct(a.alias("label"), b.alias("value")))

    def valid(self, match: Column) -> Column:
        """Whether a match is a finding."""
        ok = F.lit(True) if self.validator is None else self.validator(match["value"])
        return ok if self.alone is None else ok & ((match["label"] != "") | self.alone(match["value"]))

    def found(self, text: Column) -> Column:
        """The matched strings that are findings, in order; empty for a null text."""
        if self.label:
            every = F.filter(self.matches(text), self.valid)
            values = F.transform(every, lambda m: m["value"])
        else:
            values = F.regexp_extract_all(text, F.lit(self.regex), F.lit(0))
            values = values if self.validator is None else F.filter(values, self.validator)
        return F.coalesce(values, F.array().cast("array<string>"))

    def applies(self, page: Column | None) -> Column:
        return F.lit(True) if self.pages is None or page is None else page.isin(*self.pages)


def labeled(label: str, name: str | None = None) -> Rule:
    """A label, an optional ":" or "#", and a value of letters, digits, "-" and "/": all of it is the finding."""
    return Rule(name or f"labeled:{label}", re.sub(r"([^\w\s])", r"\\\1", label).replace(" ", r"\ ") + r"\s*[:#]?\s*([A-Za-z0-9][A-Za-z0-9\-/]*)")


RULES = {
    r.name: r for r in (
        Rule("ssn", SSN), Rule("phone", PHONE), Rule("email", EMAIL), Rule("icd10", ICD10_PREFIX), Rule("icd10_code", ICD10_CODE),
        Rule("icd10_labeled", ICD10_CATEGORY + r"(?:\.[0-9A-Z]{1,4})?\b", label=ICD10_LABEL), Rule("card", CARD, v.luhn), Rule("isodate", ISO_DATE), Rule("zip", ZIP), Rule("nhs", NHS),
        Rule("pan", PAN), Rule("aadhaar", AADHAAR, v.verhoeff), Rule("iban", IBAN, v.iban), Rule("aba", ABA, v.aba), Rule("swift", SWIFT, v.bic, label=SWIFT_LABEL, alone=lambda m: m.rlike("[0-9]")),
        Rule("ein", EIN), Rule("itin", ITIN, v.itin), Rule("npi", NPI, v.npi), Rule("ipv4", IPV4),
    )
}
FINANCIAL = [RULES[n] for n in ("iban", "aba", "card", "swift", "ein", "itin")]
MEDICAL = [RULES[n] for n in ("npi", "icd10_code", "icd10_labeled")]
GENERAL = [RULES[n] for n in ("ssn", "email", "phone", "pan", "aadhaar", "ipv4", "isodate")]
SETS = {"financial": FINANCIAL, "medical": MEDICAL, "general": GENERAL}


def findings(docs: DataFrame, rules: Sequence[Rule], text_col: str = "text", page_col: str | None = None) -> DataFrame:
    """One row per finding: docs' columns less the text, rule, seq (its number within rule and row, from 1) and match.

    A narrow pass over the rows: every rule's pattern is a literal, so it is compiled once, and nothing is shuffled.
    """
    text = F.col(text_col)
    page = F.col(page_col) if page_col else None
    per = [F.when(r.applies(page), F.transform(r.found(text), lambda m, i: F.struct(i.alias("i"), m.alias("m")))).otherwise(F.array().cast("array<struct<i:int,m:string>>")) for r in rules]
    named = [_named(a, r.name) for a, r in zip(per, rules, strict=True)]
    rest = [c for c in docs.columns if c != text_col]
    return docs.select(*rest, F.explode(F.concat(*named)).alias("_f")).select(*rest, "_f.rule", "_f.seq", "_f.match")


def _named(found: Column, name: str) -> Column:
    return F.transform(found, lambda x: F.struct(F.lit(name).alias("rule"), (x["i"] + 1).alias("seq"), x["m"].alias("match")))


def counts(docs: DataFrame, rules: Sequence[Rule], by: Sequence[str], text_col: str = "text", page_col: str | None = None) -> DataFrame:
    """Findings per row key and rule (rows without findings have none): added up before the shuffle."""
    page = F.col(page_col) if page_col else None
    per = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.when(r.applies(page), F.size(r.found(F.col(text_col)))).otherwise(0).alias("n")) for r in rules])
    rows = docs.select(*by, F.explode(F.filter(per, lambda x: x["n"] > 0)).alias("x"))
    return rows.groupBy(*by, "x.rule").agg(F.sum("x.n").alias("n_found"))


def redact(docs: DataFrame, rules: Sequence[Rule], text_col: str = "text", mask: str = "█", page_col: str | None = None) -> DataFrame:
    """docs with every finding replaced by as many mask characters as it has; other columns pass through.

    Rules with a validator replace only valid matches: the text between matches is kept and each match is looked at.
    Every rule reads the last one's text, a projection over a projection, so that the plan grows with the rules alone.
    """
    for r in rules:
        text = F.col(f"`{text_col}`")

        parts = F.zip_with(F.split(text, r.regex, -1), F.transform(r.matches(text), _masker(r, mask)), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
        docs = docs.withColumn(text_col, F.when(text.rlike(r.regex) & r.applies(F.col(page_col) if page_col else None), F.array_join(parts, "")).otherwise(text))
    return docs


def survivors(docs: DataFrame, rules: Sequence[Rule], text_cols: Sequence[str] = ("text",), by: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Findings still in any of a row's texts: (by..., source, rule, match). An empty result means that nothing survives."""
    out = None
    for c in text_cols:
        one = findings(docs.select(*by, F.col(c).alias("text")), rules).select(*by, F.lit(c).alias("source"), "rule", "match")
        out = one if out is None else out.unionByName(one)
    return out


def _masker(r: Rule, mask: str) -> Callable[[Column], Column]:
    return lambda m: F.concat(m["label"], F.when(r.valid(m), F.repeat(F.lit(mask), F.length(m["value"]))).otherwise(m["value"]))


class RedactionIncomplete(RuntimeError):
    """Findings survive after the last pass; nothing was written."""


def redacted(docs: DataFrame, rules: Sequence[Rule], text_col: str = "text", passes: int = 3, **settings) -> tuple[DataFrame, int]:
    """Redacted docs, whole or not at all, and how many passes it took: each pass is written to the shared folder and searched again."""
    for n in range(1, passes + 1):
        docs = settled(redact(docs, rules, text_col, **settings))
        if survivors(docs.select(F.lit(0).alias("_row"), F.col(f"`{text_col}`")), rules, [text_col], ["_row"]).isEmpty():
            return docs, n
    raise RedactionIncomplete(f"findings survive {passes} passes")


def write_redacted(docs: DataFrame, rules: Sequence[Rule], path: str, text_col: str = "text", passes: int = 3, **settings) -> int:
    """Redacts and writes Parquet, all or nothing: the text is searched again, up to `passes` times, before the write. Returns the passes."""
    docs, n = redacted(docs, rules, text_col, passes, **settings)
    docs.write.parquet(path)
    return n
