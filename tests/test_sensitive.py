"""Labelled rules against patterns that look behind instead, and redaction by whole sets."""

import re

from pagemill.operators import detection as d
from pagemill.plans import sensitive
from tests import oracle

ICD = r"(?i:\bicd(?:[ -]?10)?(?:[ -]?cm)?|\bdx|\bdiagnosis)\b[ \t]*[:#]?[ \t]*(?:(?i:code)\b[ \t]*[:#]?[ \t]*)?"
BIC = r"\b(?i:bic|swift)\b(?:[ -]?(?i:code)\b)?[ \t]*[:#]?[ \t]*"
BANK = r"[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b"


def count(text, fits):
    at = n = 0
    while at < len(text):
        m = fits(text, at)
        n, at = n + (m is not None), m.end() if m else at + 1
    return n


def icd(text, at):
    m = re.compile(rf"{d.ICD10_CATEGORY}(?:\.[0-9A-Z]{{1,4}})?\b").match(text, at)
    return m if m and re.search(rf"{ICD}\Z", text[:at]) else None


def swift(text, at):
    m = re.compile(BANK).match(text, at)
    alone = m and re.search(r"[0-9]", m[0]) and not re.match(r"\w", text[at - 1 : at])
    return m if m and m[0][4:6] in ("DE", "IN", "IT") and (alone or re.search(rf"{BIC}\Z", text[:at])) else None


def test_labelled_rules(spark):
    got = {(r.doc_id, r.rule): r.n_found for r in sensitive.QUERIES["pii_sets"](spark, oracle.SF).collect()}
    for name, fits in (("icd10_labeled", icd), ("swift", swift)):
        want = {i: n for i, t in sensitive.EXTRA if (n := count(t, fits))}
        assert {i: n for (i, rule), n in got.items() if rule == name and i >= 10**9} == want and want
    assert got[1000000002, "icd10_labeled"] == 2 and got[1000000007, "swift"] == 4
    far = spark.createDataFrame([(1, f"dx{' ' * 60}E11, swift{' ' * 60}HOSPITAL")], "doc_id long, text string")
    assert sorted(r.match for r in d.findings(far, [d.RULES["icd10_labeled"], d.RULES["swift"]]).collect()) == ["E11", "HOSPITAL"]


def test_digits_however_they_are_separated(spark):
    t = spark.createDataFrame([(1, "2341 2341 2346, 2341\t2341\t2346 2341\n2341\n2346")], "doc_id long, text string")
    assert d.findings(t, [d.RULES["aadhaar"]]).count() == 3


def test_redaction_by_whole_sets(spark):
    """All nineteen rules in one plan that grows with their number; labels and invalid matches stay."""
    docs = spark.createDataFrame(sensitive.EXTRA + [(5, None), (6, "")], "doc_id long, text string")
    plan = d.redact(docs, list(d.RULES.values()))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") <= len(d.RULES) + 2  # two for the two rules with labels
    out, passes = d.redacted(docs, list(d.RULES.values()), mask="#")
    text = {r.doc_id: r.text for r in out.collect()}
    assert passes <= 3 and text[5] is None and text[6] == "" and d.survivors(out, list(d.RULES.values())).isEmpty()
    assert text[1000000007].startswith("SWIFT: ########, ###########") and "TREATMENT APPROVED" in text[1000000007]
    assert all(len(text[i]) == len(t) for i, t in sensitive.EXTRA)
