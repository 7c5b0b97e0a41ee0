"""Secret scans: pattern candidates, told apart by how many owners and repositories of the whole corpus hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import guarded, stage

# What a base span is. The key words of an assignment match in either case, letter by letter, so that no
# engine's Unicode case folding takes part.
_VALUE = "[A-Za-z0-9+/_.=-]+"


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGN = "(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key"))) + ")[\"']?\\x20*[:=]\\x20*[\"']?(" + _VALUE + ")"
#: Runs that fail their least length can hide no later match, so the length may be part of these two patterns.
ACCESS, HEX = "AKIA[A-Z0-9]{14,}", "[0-9a-f]{16,}"
#: What the method adds: long runs of mixed characters, if one owner alone has them.
MIXED = "[A-Za-z0-9+/_-]{20,}"
LEAST_VALUE = 12
KINDS = ("assign", "access", "hex", "owned")
#: A value that this many owners have, or this many repositories of whichever owners, is a copied example.
COPIED, WIDE = 2, 10
_CHUNK = 256


def running(sizes: Column) -> Column:
    """Running sums of an array<int>, in chunks of chunks so that long arrays aren't copied for every element."""

    def sums(values: Column, base: Column) -> Column:
        start = F.struct(base.cast("long").alias("s"), F.array().cast("array<bigint>").alias("a"))

        def step(acc, x):
            s = acc["s"] + x
            return F.struct(s.alias("s"), F.array_append(acc["a"], s).alias("a"))

        return F.aggregate(values, start, step, lambda acc: acc["a"])

    def whole(sizes: Column) -> Column:
        n = F.ceil(F.size(sizes) / _CHUNK).cast("int")
        chunks = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda c: F.slice(sizes, c * _CHUNK + 1, _CHUNK))).otherwise(F.array().cast("array<array<bigint>>"))
        ends = sums(F.transform(chunks, lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))
        bases = F.concat(F.array(F.lit(0).cast("long")), ends)
        return F.flatten(F.zip_with(chunks, F.slice(bases, 1, F.greatest(n, F.lit(1))), lambda c, b: sums(F.coalesce(c, F.array().cast("array<bigint>")), b)))

    # A one-element array's transform works sizes out once, not once a chunk.
    return F.element_at(F.transform(F.array(sizes), whole), 1)


def matches(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, kind, end, value>>, in code points, end exclusive.

    Places follow from the lengths of the matches and of what lies between them. value is the group; matches whose
    value is shorter than `least` are dropped after matching.
    """
    p = F.lit(pattern)
    found = F.regexp_extract_all(text, p, F.lit(0))
    between = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    ends = running(F.zip_with(between, found, lambda a, b: (F.length(a) + F.length(b)).cast("long")))
    values = F.regexp_extract_all(text, p, F.lit(group)) if group else found
    spans = F.zip_with(F.zip_with(ends, found, lambda e, m: F.struct(e.alias("e"), F.length(m).alias("n"))), values,
                       lambda x, v: F.struct((x["e"] - x["n"]).alias("start"), F.lit(kind).alias("kind"), x["e"].alias("end"), v.alias("value")))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value:string>>")
    if least:
        spans = F.filter(spans, lambda s: F.length(s["value"]) >= least)
    return F.when(text.rlike(pattern), spans).otherwise(none)


def _mixed(text: Column, base: Column) -> Column:
    """Candidates of the method's own: mixed runs that touch no base span."""
    runs = matches(text, MIXED, 3)
    runs = F.filter(runs, lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]"))
    return F.filter(runs, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))


@guarded("_owner", "_repo", "_key", "_k", "_text", "_base", "_all", "_spans")
def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """One row per document: the columns of `keep` (the id alone, if None), n_assign, n_access, n_hex and spans.

    spans: array<struct<start, kind, end, hash, n_owners, n_repos, verdict>> in order of start and kind, where kind
    indexes KINDS. Values are hashed (SHA-256); for each hash of the corpus its distinct owners, and the repositories of
    each of them, are counted; a value of COPIED owners or WIDE repositories or more is an "example", any other "live".
    Base spans stay whatever their verdict; spans of the method's own kind stay if live. Values never leave their document's row but as hashes.

    repo_col: the repository; a document is its own, if None. A null owner or repository counts as one more of them. Null
    texts are empty; empty texts have no spans; equal rows get equal ones; an empty table gives no rows.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    repo = F.col(f"`{repo_col or id_col}`").cast("string")
    names = keep or [id_col]
    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{owner_col}`").cast("string").alias("_owner"), repo.alias("_repo"),
                       F.sha2(F.concat(F.coalesce(F.concat(F.col(f"`{id_col}`").cast("string"), F.lit(":")), F.lit("?")), text), 256).alias("_key"), text.alias("_text"))
    rows = rows.withColumn("_base", F.concat(matches(F.col("_text"), ASSIGN, 0, 2, LEAST_VALUE), matches(F.col("_text"), ACCESS, 1), matches(F.col("_text"), HEX, 2)))
    rows = rows.withColumn("_all", F.concat("_base", _mixed(F.col("_text"), F.col("_base"))))
    hashed = F.transform("_all", lambda s: F.struct(s["start"], s["kind"], s["end"], F.sha2(s["value"], 256).alias("hash")))
    rows = stage(rows.withColumn("_spans", F.array_sort(hashed)).drop("_text", "_base", "_all"), "secrets")
    found = rows.select("_key", "_owner", "_repo", F.explode("_spans").alias("s")).select("_key", "_owner", "_repo", "s.*")
    owners = found.groupBy("hash", "_owner", "_repo").agg(F.lit(1).alias("one")).groupBy("hash", "_owner").agg(F.count(F.lit(1)).alias("n")).groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_repos"))
    spans = found.select("_key", "start", "kind", "end", "hash").distinct().join(owners, "hash")
    spans = spans.withColumn("verdict", F.when((F.col("n_owners") >= COPIED) | (F.col("n_repos") >= WIDE), "example").otherwise("live")).where((F.col("kind") < 3) | (F.col("verdict") == "live"))
    spans = spans.groupBy(F.col("_key").alias("_k")).agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "hash", "n_owners", "n_repos", "verdict"))).alias("spans"))
    out = rows.join(spans, rows["_key"] == spans["_k"], "left")
    none = F.array().cast(spans.schema["spans"].dataType)

    def number(k: int) -> Column:
        return F.size(F.filter("_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    count = [number(k) for k in range(3)]
    return out.select(*[F.col(f"`{c}`") for c in names if c not in ("spans", "n_assign", "n_access", "n_hex")], *count, F.coalesce("spans", none).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kind, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    out = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    live = F.size(F.filter("spans", lambda s: s["verdict"] == "live"))
    told = [(F.size("spans") - live).cast("long").alias("n_example"), live.cast("long").alias("n_live")]
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), *told)


def _sql_spans(pattern: str, kind: int, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""
  SELECT r, s + 0 AS start, {kind} AS kind, s + n AS "end", v FROM (
    SELECT r, unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))) AS s,
      unnest(list_transform(m, lambda x: length(x))) AS n, unnest(v) AS v
    FROM (SELECT r, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS g, regexp_extract_all(text, '{p}', {group}) AS v FROM doc WHERE regexp_matches(text, '{p}')))
  WHERE length(v) >= {least}"""


SQL = f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
base AS ({_sql_spans(ASSIGN, 0, 2, LEAST_VALUE)} UNION ALL {_sql_spans(ACCESS, 1, 0, 0)} UNION ALL {_sql_spans(HEX, 2, 0, 0)}),
own AS (
  SELECT * FROM ({_sql_spans(MIXED, 3, 0, 0)}) o
  WHERE regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = o.r AND b.start < o."end" AND o.start < b."end")),
every AS (SELECT * FROM base UNION ALL SELECT * FROM own),
owners AS (
  SELECT v, count(DISTINCT owner) >= {COPIED} OR count(DISTINCT (owner, repo)) >= {WIDE} AS example
  FROM (SELECT v, coalesce('s' || source, '') AS owner, coalesce(CAST(doc_id AS VARCHAR), '') AS repo FROM every JOIN doc USING (r)) GROUP BY v),
said AS (SELECT r, kind, start, example, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || CAST(start AS BIGINT) || ':' || CAST("end" AS BIGINT) AS s FROM every JOIN owners USING (v) WHERE kind < 3 OR NOT example),
per AS (
  SELECT r, count(*) FILTER (WHERE kind = 0) AS a, count(*) FILTER (WHERE kind = 1) AS b, count(*) FILTER (WHERE kind = 2) AS c,
    string_agg(s, ',' ORDER BY start, kind) FILTER (WHERE kind < 3) AS base, string_agg(s, ',' ORDER BY start, kind) AS spans,
    count(*) FILTER (WHERE example) AS x, count(*) FILTER (WHERE NOT example) AS l
  FROM said GROUP BY r)
SELECT doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(b, 0) AS BIGINT) AS n_access, CAST(coalesce(c, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  CAST(coalesce(x, 0) AS BIGINT) AS n_example, CAST(coalesce(l, 0) AS BIGINT) AS n_live
FROM doc LEFT JOIN per USING (r)
"""
