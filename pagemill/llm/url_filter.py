"""URL filters: curated host and path rules, and association rules that FP-growth mines from labelled URLs."""

from __future__ import annotations

import math
from itertools import product

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.common import guarded, stage, without

OUT = ["host", "path", "rule", "verdict"]
BLOCK, ALLOW = "block", "allow"
#: (host, path, verdict)
RULES = (("net", "/", BLOCK), ("example.net", "/en/", ALLOW), ("example.com", "/de/", BLOCK), ("org", "/fr/", ALLOW))
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str, str, str]:
    """(scheme, host, path, rest); all empty if there is no "://". The host is lower-cased (A-Z), rest starts at ? or #."""
    scheme, mark, tail = (url or "").partition("://")
    if not mark:
        return "", "", "", ""
    at = min((i for i in map(tail.find, "/?#") if i >= 0), default=len(tail))
    host, tail = tail[:at].translate(_LOWER), tail[at:]
    at = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return scheme, host, tail[:at], tail[at:]


def tokens_of(url: str | None) -> list[str]:
    """A URL's distinct tokens: its scheme, every suffix of its host and label but the last, every path part with its place, its extension, every query name, whether it has a fragment."""
    scheme, host, path, rest = split_url(url)
    if not host and not path:
        return []
    labels = host.split(".")
    out = [f"scheme:{scheme.translate(_LOWER)}"] + [f"host:{'.'.join(labels[-k:])}" for k in range(1, len(labels) + 1)]
    out += [f"label:{x}" for x in labels[:-1]]
    parts = [p for p in path.split("/") if p]
    out += [f"path{k}:{p}" for k, p in enumerate(parts)]
    if parts and "." in parts[-1]:
        out.append(f"ext:{parts[-1].rpartition('.')[2]}")
    query, mark, _ = rest.partition("#")
    out += [f"query:{n.partition('=')[0]}" for n in query.lstrip("?").split("&") if n]
    return sorted({*out, *(["fragment"] if mark else [])})


class Curated:
    """Host and path rules: a rule fits its host and all subdomains if the URL's path starts with the rule's; the longest wins."""

    def __init__(self, rules):
        self.by_host: dict[str, list[tuple[int, str, str, str]]] = {}
        for host, path, verdict in rules:
            self.by_host.setdefault(host, []).append((len(host) + len(path), host, path, verdict))

    def judge(self, host: str, path: str) -> tuple[str | None, str | None]:
        best, rest = None, host
        while True:
            for rule in self.by_host.get(rest, ()):
                if path.startswith(rule[2]) and (best is None or rule[:2] > best[:2]):
                    best = rule
            _, dot, rest = rest.partition(".")
            if not dot:
                return (best[1] + best[2], best[3]) if best else (None, None)


class Mined:
    """Association rules by an inverted index: each under its least frequent token, looked up by the tokens of a URL."""

    def __init__(self, rules: list[tuple[frozenset[str], str, float, float]]):
        often: dict[str, int] = {}
        for items, *_ in rules:
            for t in items:
                often[t] = often.get(t, 0) + 1
        self.index: dict[str, list] = {}
        for items, verdict, confidence, support in rules:
            key = min(items, key=lambda t: (often[t], t))
            self.index.setdefault(key, []).append((items, verdict, confidence, support))

    def judge(self, tokens: list[str]) -> str | None:
        """The verdict of the rule with the highest confidence, then most tokens, then support; block before allow."""
        have, best = set(tokens), None
        for t in tokens:
            for items, verdict, confidence, support in self.index.get(t, ()):
                if items <= have:
                    key = (confidence, len(items), support, verdict == BLOCK)
                    if best is None or key > best[0]:
                        best = (key, verdict)
        return best and best[1]


def prune(rules: list[tuple[frozenset[str], str, float, float]]) -> list[tuple[frozenset[str], str, float, float]]:
    """Rules less those that some rule with fewer of their tokens and the same verdict is as sure as."""
    kept: dict[tuple[frozenset[str], str], float] = {}
    out = []
    for items, verdict, confidence, support in sorted(rules, key=lambda r: (len(r[0]), sorted(r[0]), r[1])):
        smaller = [frozenset(items - {t}) for t in items]
        best = max((kept.get((s, verdict), 0.0) for s in smaller), default=0.0)
        kept[(items, verdict)] = max(best, confidence)
        if confidence > best:
            out.append((items, verdict, confidence, support))
    return out


def mine(urls: DataFrame, url_col: str = "url", label_col: str = "label", support: float = 0.01, confidence: float = 0.8) -> list[tuple[frozenset[str], str, float, float]]:
    """Rules tokens -> label that FP-growth finds in URLs, some of them labelled, pruned by support and confidence.

    All of a URL's tokens count. Only those of at least `support` of the rows can be in a rule: these are fewer than the
    average number of tokens over the support, whatever the corpus, and fit the driver. Tokens that are in the very same
    rows are one item for FP-growth, so that a long host, path or query that many URLs share makes no more sets than a
    short one; in the rules each stands for the others. URLs without a label count as such: a rule's confidence is the
    label's share of all URLs with its tokens, so that a few labelled ones don't speak for many others. FP-growth deals
    conditional trees out by token and sums equal transactions, so no token is a hot group. Null URLs teach nothing.
    """
    def transactions(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([[*tokens_of(u), *([f"={y}"] if y else [])] for u, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], pa.list_(pa.string()))], ["items"])

    known = urls.select(F.col(f"`{url_col}`").alias("u"), F.col(f"`{label_col}`").cast("string").alias("y")).where("u is not null")
    items = stage(known.mapInArrow(transactions, "items array<string>"), "transactions")
    n = items.count()
    if not n:
        return []
    rows = F.sum(F.col("h").cast("decimal(38,0)"))
    often = items.select(F.explode("items").alias("t"), F.xxhash64("items").alias("h")).groupBy("t").agg(F.count(F.lit(1)).alias("n"), rows.alias("rows"))
    classes: dict[tuple, list[str]] = {}
    for t, *key in often.where((F.col("n") >= math.ceil(support * n)) & ~F.col("t").startswith("=")).orderBy("t").collect():
        classes.setdefault(tuple(key), []).append(t)
    same = {ts[0]: ts for ts in classes.values()}

    def frequent(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([[t for t in ts if t in same or t.startswith("=")] for ts in batch.column(0).to_pylist()], pa.list_(pa.string()))], ["items"])

    items = stage(items.mapInArrow(frequent, "items array<string>"), "transactions")
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items)
    found = model.associationRules.where(F.element_at("consequent", 1).startswith("=")).select("antecedent", F.element_at("consequent", 1).alias("y"), "confidence", "support").collect()
    few = prune([(frozenset(r.antecedent), r.y[1:], r.confidence, r.support) for r in found])
    return [(frozenset(items), *rest) for own, *rest in few for items in product(*[same[t] for t in own])]


@guarded("_u")
def filter_urls(pages: DataFrame, url_col: str = "url", rules=RULES, labelled: DataFrame | None = None, support: float = 0.01, confidence: float = 0.8, otherwise: str = ALLOW, keep: list[str] | None = None) -> DataFrame:
    """Adds host, path, rule (like "net/", or null) and verdict to each row.

    A curated rule that fits decides. Other URLs go by mined rules, and those that none matches get `otherwise`. Rules
    are mined from `labelled` (url_col and label), or, if None, from the pages that curated rules decide. Every row is
    judged. Null URLs and those without "://" have an empty host and path and no rule, and are judged `otherwise`; equal
    URLs get equal verdicts; an empty table gives no rows. Input columns named like an output column are replaced. keep:
    the input columns to return (all, if None).
    """
    curated = Curated(rules)
    src = pages if url_col in OUT else without(pages, OUT)
    fields = [src.schema[c] for c in src.columns if (keep is None or c in keep) and c not in OUT]
    schema = T.StructType([*fields, *[T.StructField(c, T.StringType()) for c in OUT]])
    if labelled is None:
        def label(batches):
            for batch in batches:
                urls = batch.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([curated.judge(*split_url(u)[1:3])[1] for u in urls], pa.string())], ["url", "label"])

        mined = Mined(mine(pages.select(F.col(f"`{url_col}`").cast("string").alias("url")).mapInArrow(label, "url string, label string"), support=support, confidence=confidence))
    else:
        mined = Mined(mine(labelled, url_col, support=support, confidence=confidence))

    def judge(batches):
        for batch in batches:
            out = []
            for url in batch.column("_u").to_pylist():
                _, host, path, _ = split_url(url)
                rule, verdict = curated.judge(host, path)
                out.append((host, path, rule, verdict or mined.judge(tokens_of(url)) or otherwise))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array([r[k] for r in out], pa.string()) for k in range(4)]], schema.fieldNames())

    return src.select(*[F.col(f"`{f.name}`") for f in fields], F.col(f"`{url_col}`").cast("string").alias("_u")).mapInArrow(judge, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), keep=["page_id"])
