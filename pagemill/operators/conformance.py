"""What keeps documents from being archived as they are: one filter a rule over the relations of their files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.sources import pdf

HIDDEN = 2 | 32


def findings(files: DataFrame) -> DataFrame:
    """(doc_id, rule, n): how often a document breaks each rule; rules it keeps have no row, nor do files that can't be read.

    Every file is opened once; only counts per document and rule are shuffled.
    """
    value, active, note = F.col("objects.value"), F.col("active.category"), F.col("annotations")
    kind = F.get_json_object(value, "$.Type")
    metadata = kind == "/Metadata"
    intent = (kind == "/Catalog") & F.get_json_object(value, "$.OutputIntents").isNotNull()
    broken = F.array(
        F.when(F.col("documents.encrypted"), "encrypted"),
        F.when(F.get_json_object(value, "$.Filter").contains("LZW"), "lzw"),
        F.when(active.isin("javascript", "attachment"), active),
        F.when(F.col("layers").isNotNull(), "layers"),
        F.when(~F.col("fonts.embedded"), "font-not-embedded"),
        F.when(~note["appearance"] & ~note["subtype"].isin("Popup", "Link"), "annotation-without-appearance"),
        F.when(note["flags"].bitwiseAND(HIDDEN) != 0, "annotation-hidden"),
        F.when(F.col("ops.alpha") < 1, "transparency"),
        # Not rules: that a document was read, and what it has.
        F.when(value.isNotNull(), ""), F.when(metadata, "+no-metadata"), F.when(intent, "+no-output-intent"),
    )
    rows = pdf.relations(files, ["documents", "objects", "active", "layers", "fonts", "annotations", "ops"])
    out = rows.select("doc_id", F.explode(F.array_compact(broken)).alias("rule")).groupBy("doc_id", "rule").agg(F.count(F.lit(1)).alias("n"))
    has = out.groupBy("doc_id").agg(F.collect_list(F.struct("rule", "n")).alias("_r"))
    names = F.transform("_r", lambda r: r["rule"])
    lacks = F.transform(F.filter(F.array(F.lit("no-metadata"), F.lit("no-output-intent")), lambda r: F.array_contains(names, "") & ~F.array_contains(names, F.concat(F.lit("+"), r))), lambda r: F.struct(r.alias("rule"), F.lit(1).cast("long").alias("n")))
    kept = F.filter("_r", lambda r: (r["rule"] != "") & ~r["rule"].startswith("+"))
    return has.select("doc_id", F.explode(F.concat(kept, lacks)).alias("r")).select("doc_id", "r.rule", "r.n")
