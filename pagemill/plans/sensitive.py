"""Queries over documents: detection, redaction, verification, search. Each with SQL that DuckDB runs, where it has the regular expressions."""

from __future__ import annotations

from importlib import resources

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators import detection as d
from pagemill.operators import search

#: Rows beside the documents, so that rules without a hit in them are tried too.
EXTRA = [
    (1000000001, "SSN 123-45-6789, again 987-65-4321x; call (555) 123-4567 or 555-123-4567 or 555.123.4567."),
    (1000000002, "Dx: E11 and J45.901, C4A, B2B; icd-10 code: M1A.0; A12"),
    (1000000003, "cards 4532 0151 1283 0366, 4532-0151-1283-0367 and 79927398713; NHS 943 476 5919"),
    (1000000004, "ABCDE1234F is a PAN; Aadhaar 2341 2341 2346, 9999 9999 0019, 234123412341, 2341\t2341\n2346"),
    (1000000005, "IBAN GB82WEST12345698765432, GB83WEST12345698765432, DE89370400440532013000"),
    (1000000006, "routing 021000021 and 021000022; EIN 12-3456789; ITIN 912-70-1234, 912-93-1234, 812-70-1234"),
    (1000000007, "SWIFT: DEUTDEFF, HDFCINBB0XX, ICICINBB001; TREATMENT APPROVED BY ONCOLOGY HOSPITAL; bic code # HOSPITAL"),
    (1000000008, "NPI 1234567893, 1234567890; zip 12345-6789, 54321; 2024-01-31, 1999/12/01; 10.0.0.255, 256.1.1.1, 1.2.3.4"),
    (1000000009, "MRN: 0099123 and MRN#A-1/2, a.b@c.example, x@y"),
]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame(EXTRA, "doc_id long, text string")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(extra)


def _values() -> str:
    rows = ", ".join(f"({i}, '{t}')" for i, t in EXTRA)  # the same bytes: tabs and line ends as they are
    return f"docs AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES {rows}) v(doc_id, text))"


_D = "regexp_replace(m, '[^0-9]', '', 'g')"


def _luhn(digits: str) -> str:
    x = f"(ascii(substr(reverse({digits}), i, 1)) - 48)"
    return f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 0 THEN (2 * {x}) // 10 + (2 * {x}) % 10 ELSE {x} END)) % 10 = 0"


# The scheme's published tables, so that the check doesn't lean on the rule that the code builds them by.
_GROUP_TABLE = [
    0, 1, 2, 3, 4, 5, 6, 7, 8, 9,
    1, 2, 3, 4, 0, 6, 7, 8, 9, 5,
    2, 3, 4, 0, 1, 7, 8, 9, 5, 6,
    3, 4, 0, 1, 2, 8, 9, 5, 6, 7,
    4, 0, 1, 2, 3, 9, 5, 6, 7, 8,
    5, 9, 8, 7, 6, 0, 4, 3, 2, 1,
    6, 5, 9, 8, 7, 1, 0, 4, 3, 2,
    7, 6, 5, 9, 8, 2, 1, 0, 4, 3,
    8, 7, 6, 5, 9, 3, 2, 1, 0, 4,
    9, 8, 7, 6, 5, 4, 3, 2, 1, 0,
]
_PLACE_TABLE = [
    0, 1, 2, 3, 4, 5, 6, 7, 8, 9,
    1, 5, 7, 6, 2, 8, 3, 0, 9, 4,
    5, 8, 0, 3, 7, 9, 6, 1, 4, 2,
    8, 9, 1, 6, 0, 4, 3, 5, 2, 7,
    9, 4, 5, 3, 1, 2, 6, 8, 7, 0,
    4, 2, 8, 6, 5, 7, 3, 9, 0, 1,
    2, 7, 9, 3, 8, 0, 6, 4, 1, 5,
    7, 0, 4, 6, 9, 1, 3, 2, 5, 8,
]
_TURNED = "(substr(m, 5) || substr(m, 1, 4))"
_CODE = f"CASE WHEN ascii(substr({_TURNED}, i, 1)) >= 65 THEN ascii(substr({_TURNED}, i, 1)) - 55 ELSE ascii(substr({_TURNED}, i, 1)) - 48 END"
_GROUP = "CAST(substr(m, 5, 2) AS INT)"
_SQL_VALID = {
    "card": _luhn(_D), "npi": _luhn("('80840' || m)"), "aadhaar": f"list_reduce(list_prepend(0, list_transform(list_filter(string_split(reverse(m), ''), lambda c: c BETWEEN '0' AND '9'), lambda c, i: {_PLACE_TABLE}[((i - 1) % 8) * 10 + ascii(c) - 48 + 1])), lambda c, v: {_GROUP_TABLE}[c * 10 + v + 1]) = 0",
    "iban": f"length(m) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform(range(1, length(m) + 1), lambda i: {_CODE})), lambda r, c: CASE WHEN c > 9 THEN (r * 100 + c) % 97 ELSE (r * 10 + c) % 97 END) = 1",
    "aba": "list_sum(list_transform(range(1, 10), lambda i: [3, 7, 1][(i - 1) % 3 + 1] * (ascii(substr(m, i, 1)) - 48))) % 10 = 0",
    "itin": f"({_GROUP} BETWEEN 50 AND 65 OR {_GROUP} BETWEEN 70 AND 88 OR {_GROUP} BETWEEN 90 AND 92 OR {_GROUP} BETWEEN 94 AND 99)",
}


def _countries() -> str:
    """ISO 3166-1 codes of the time-zone database, and XK, as a list."""
    table = (resources.files("tzdata") / "zoneinfo" / "iso3166.tab").read_text(encoding="utf-8")
    return str(sorted({*(line[:2] for line in table.splitlines() if line and line[0] != "#"), "XK"}))


_SQL_VALID["swift"] = f"list_contains({_countries()}, substr(m, 5, 2))"


def _regex(name: str) -> str:
    return d.RULES[name].regex.replace("'", "''")


def _pairs(name: str, text: str = "text") -> str:
    """All matches of a rule as a list of structs (l: the label in front, m: the value)."""
    p, rule = _regex(name), d.RULES[name]
    if not rule.label:
        return f"list_transform(regexp_extract_all({text}, '{p}'), lambda x: {{'l': '', 'm': x}})"
    return f"list_transform(list_zip(regexp_extract_all({text}, '{p}', 1), regexp_extract_all({text}, '{p}', 2)), lambda x: {{'l': coalesce(x[1], ''), 'm': x[2]}})"


def _found(name: str) -> str:
    if name not in _SQL_VALID and not d.RULES[name].label:
        return f"regexp_extract_all(text, '{_regex(name)}')"
    values = f"list_transform({_pairs(name)}, lambda x: x.m)" if not d.RULES[name].alone else f"list_transform(list_filter({_pairs(name)}, lambda x: x.l <> '' OR regexp_matches(x.m, '[0-9]')), lambda x: x.m)"
    return f"list_filter({values}, lambda m: {_SQL_VALID[name]})" if name in _SQL_VALID else values


def _rule(name: str):
    return lambda spark, sf_dir: d.findings(_docs(spark, sf_dir), [d.RULES[name]])


def _rule_sql(name: str) -> str:
    return f"WITH {_values()}, f AS (SELECT doc_id, {_found(name)} AS ms FROM docs) SELECT doc_id, '{name}' AS rule, CAST(i AS INT) AS seq, ms[i] AS \"match\" FROM (SELECT doc_id, ms, unnest(range(1, len(ms) + 1)) AS i FROM f)"


QUERIES = {f"pii_{n}": _rule(n) for n in d.RULES}
ORACLES = {f"pii_{n}": _rule_sql(n) for n in d.RULES}

#: A card's pattern may end with a separator before a letter that only one of the two engines takes for a word's; it is cut off.
QUERIES["pii_card"] = lambda spark, sf_dir: _rule("card")(spark, sf_dir).withColumn("match", F.rtrim("match"))
ORACLES["pii_card"] = f"SELECT doc_id, rule, seq, rtrim(\"match\") AS \"match\" FROM ({_rule_sql('card')})"

_SET = [r for name in ("financial", "medical", "general") for r in d.SETS[name]]
QUERIES["pii_sets"] = lambda spark, sf_dir: d.counts(_docs(spark, sf_dir), _SET, ["doc_id"])
ORACLES["pii_sets"] = f"WITH {_values()}, f AS (SELECT doc_id, " + ", ".join(f"len({_found(r.name)}) AS {r.name}" for r in _SET) + " FROM docs) " + " UNION ALL ".join(f"SELECT doc_id, '{r.name}' AS rule, CAST({r.name} AS BIGINT) AS n_found FROM f WHERE {r.name} > 0" for r in _SET)

QUERIES["agg_report"] = lambda spark, sf_dir: d.counts(_docs(spark, sf_dir), _SET, ["doc_id"]).groupBy("rule").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_found").alias("n_found"))
ORACLES["agg_report"] = f"SELECT rule, count(*) AS n_docs, CAST(sum(n_found) AS BIGINT) AS n_found FROM ({ORACLES['pii_sets']}) GROUP BY rule"

QUERIES["pii_labeled"] = lambda spark, sf_dir: d.findings(_docs(spark, sf_dir), [d.labeled("MRN"), d.labeled("token", "token")])
ORACLES["pii_labeled"] = f"WITH {_values()}, f AS (SELECT doc_id, 'labeled:MRN' AS rule, regexp_extract_all(text, 'MRN\\s*[:#]?\\s*([A-Za-z0-9][A-Za-z0-9\\-/]*)') AS ms FROM docs UNION ALL SELECT doc_id, 'token', regexp_extract_all(text, 'token\\s*[:#]?\\s*([A-Za-z0-9][A-Za-z0-9\\-/]*)') FROM docs) SELECT doc_id, rule, CAST(i AS INT) AS seq, ms[i] AS \"match\" FROM (SELECT doc_id, rule, ms, unnest(range(1, len(ms) + 1)) AS i FROM f)"

_CUSTOM = d.Rule("custom", "licen[cs]e", ignore_case=True, pages=(0, 2))
QUERIES["pii_rule"] = lambda spark, sf_dir: d.findings(_docs(spark, sf_dir).withColumn("page", F.pmod("doc_id", F.lit(4)).cast("int")), [_CUSTOM], page_col="page")
ORACLES["pii_rule"] = f"WITH {_values()}, f AS (SELECT doc_id, CAST(doc_id % 4 AS INT) AS page, regexp_extract_all(text, '(?i)licen[cs]e') AS ms FROM docs WHERE doc_id % 4 IN (0, 2)) SELECT doc_id, page, 'custom' AS rule, CAST(i AS INT) AS seq, ms[i] AS \"match\" FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM f)"

_PLAIN = [d.RULES[n] for n in ("email", "ssn", "ipv4", "isodate")]
#: Every rule of the three sets, one after the other, then searched again until nothing is left. A separator behind a card's
#: number, which only one engine takes for a part of it (see pii_card), is written as masked in both.
QUERIES["red_apply"] = lambda spark, sf_dir: d.redacted(_docs(spark, sf_dir), _SET, mask="#")[0].select("doc_id", F.regexp_replace("text", "#[ -]", "##").alias("text"))


def _masked(name: str) -> str:
    """The text with a rule's valid values masked: the pieces between matches, and each match's label and value."""
    checked = _SQL_VALID.get(name, "true")
    if d.RULES[name].alone:
        checked = f"({checked}) AND (l <> '' OR regexp_matches(m, '[0-9]'))"
    return f"""
  SELECT doc_id, CASE WHEN n = 0 THEN any_value(text) ELSE string_agg(piece || coalesce(l || CASE WHEN {checked} THEN repeat('#', length(m)) ELSE m END, ''), '' ORDER BY i) END AS text
  FROM (SELECT doc_id, text, len(ms) AS n, unnest(range(1, greatest(len(ps), 1) + 1)) AS i, ps[i] AS piece, ms[i].l AS l, ms[i].m AS m
    FROM (SELECT doc_id, text, string_split_regex(text, '{_regex(name)}') AS ps, {_pairs(name)} AS ms FROM docs)) GROUP BY doc_id, n"""


def _redacted() -> str:
    sql = f"WITH {_values()}, t0 AS (SELECT doc_id, text FROM docs)"
    for k, r in enumerate(_SET):
        sql += f", t{k + 1} AS ({_masked(r.name).replace('FROM docs))', f'FROM t{k}))')})"
    return f"{sql} SELECT doc_id, regexp_replace(text, '#[ -]', '##', 'g') AS text FROM t{len(_SET)}"


ORACLES["red_apply"] = _redacted()
QUERIES["red_verify_patterns"] = lambda spark, sf_dir: d.survivors(_docs(spark, sf_dir).withColumn("title", F.substring("text", 1, 60)), _PLAIN, ["text", "title"])
ORACLES["red_verify_patterns"] = f"WITH {_values()} " + " UNION ALL ".join(f"SELECT doc_id, '{s}' AS source, '{r.name}' AS rule, unnest(regexp_extract_all({e}, '{r.pattern}')) AS \"match\" FROM docs" for s, e in (("text", "text"), ("title", "substr(text, 1, 60)")) for r in _PLAIN)

QUERIES["srch_substring"] = lambda spark, sf_dir: _docs(spark, sf_dir).select("doc_id", F.size(search.places(F.col("text"), "the")).cast("long").alias("n"), F.size(search.places(F.col("text"), "the", whole_word=True)).cast("long").alias("n_words"))
ORACLES["srch_substring"] = f"WITH {_values()} SELECT doc_id, CAST((length(text) - length(replace(text, 'the', ''))) // 3 AS BIGINT) AS n, CAST(coalesce(list_sum(list_transform(range(1, len(string_split(text, 'the'))), lambda i: CASE WHEN regexp_matches(right(string_split(text, 'the')[i], 1), '[\\p{{L}}\\p{{N}}]') OR (string_split(text, 'the')[i] = '' AND i > 1) OR regexp_matches(left(string_split(text, 'the')[i + 1], 1), '[\\p{{L}}\\p{{N}}]') OR (string_split(text, 'the')[i + 1] = '' AND i + 1 < len(string_split(text, 'the'))) THEN 0 ELSE 1 END)), 0) AS BIGINT) AS n_words FROM docs"
QUERIES["srch_fold"] = lambda spark, sf_dir: _docs(spark, sf_dir).withColumn("m", F.explode(search.folded_places(F.col("text"), F.lit("ét")))).select("doc_id", "m.start", "m.length")


def _characters(spark: SparkSession) -> DataFrame:
    return spark.range(40).select(F.lit(1).cast("long").alias("doc_id"), F.lit(0).alias("page_index"), F.col("id").cast("int").alias("at"), F.floor(F.col("id") / 8).cast("int").alias("run"), (F.col("id") * 5.0).alias("x0"), F.lit(10.0).alias("y0"), (F.col("id") * 5.0 + 5).alias("x1"), F.lit(20.0).alias("y1"))


QUERIES["srch_boxes"] = lambda spark, sf_dir: search.boxes(spark.createDataFrame([(1, 0, 0, 6, 12), (1, 0, 1, 30, 3)], "doc_id long, page_index int, match int, start int, length int"), _characters(spark))
ORACLES["srch_boxes"] = "WITH m AS (SELECT * FROM (VALUES (CAST(1 AS BIGINT), 0, 0, 6, 12), (1, 0, 1, 30, 3)) v(doc_id, page_index, \"match\", s, n)), c AS (SELECT CAST(i AS INT) AS pos, CAST(i // 8 AS INT) AS run FROM range(40) t(i)) SELECT doc_id, page_index, \"match\", run, min(pos) * 5.0::DOUBLE AS x0, 10.0::DOUBLE AS y0, max(pos) * 5.0::DOUBLE + 5 AS x1, 20.0::DOUBLE AS y1 FROM m JOIN c ON pos >= s AND pos < s + n GROUP BY ALL"
