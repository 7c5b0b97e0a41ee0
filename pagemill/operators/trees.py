"""Form fields and outlines: trees as (doc_id, node, parent, ordinal, ...) rows, flattened by recursion in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pagemill.operators.objects import settled

DEEPEST = 1024


def _recursive(df: DataFrame, sql: str) -> DataFrame:
    """Runs SQL over df as {t}, in a session whose limits on recursion are these queries' own. df is written first: every level reads it anew."""
    spark, df = df.sparkSession, settled(df)
    wanted = {"spark.sql.cteRecursionLevelLimit": str(DEEPEST), "spark.sql.cteRecursionRowLimit": "-1"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        return settled(spark.sql(sql, t=df))
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def form_fields(fields: DataFrame) -> DataFrame:
    """(doc_id, field_id, full_name, type, flags, max_len, depth, is_leaf) of (doc_id, field_id, parent_id, ordinal, partial_name, type, flags, max_len).

    A full name joins the non-empty partial names from the root; type, flags and max_len come from the nearest field that
    has them. A field that is its own ancestor is cut where it closes the ring; up to 1,024 levels.
    """
    return _recursive(fields, """
WITH RECURSIVE walk AS (
  SELECT doc_id, field_id, coalesce(partial_name, '') AS full_name, type, flags, max_len, 0 AS depth, array(field_id) AS path
  FROM {t} WHERE parent_id IS NULL
  UNION ALL
  SELECT c.doc_id, c.field_id, CASE WHEN coalesce(c.partial_name, '') = '' THEN w.full_name WHEN w.full_name = '' THEN c.partial_name ELSE concat(w.full_name, '.', c.partial_name) END,
    coalesce(c.type, w.type), coalesce(c.flags, w.flags), coalesce(c.max_len, w.max_len), w.depth + 1, array_append(w.path, c.field_id)
  FROM walk w JOIN {t} c ON c.doc_id = w.doc_id AND c.parent_id = w.field_id WHERE NOT array_contains(w.path, c.field_id))
SELECT w.doc_id, w.field_id, w.full_name, w.type, w.flags, w.max_len, w.depth, p.parent_id IS NULL AS is_leaf
FROM walk w LEFT JOIN (SELECT DISTINCT doc_id, parent_id FROM {t} WHERE parent_id IS NOT NULL) p ON p.doc_id = w.doc_id AND p.parent_id = w.field_id""")


def outline(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, title, page_index, depth, place) of (doc_id, node_id, parent_id, ordinal, title, page_index): place, the ordinals from the root, sorts a document's bookmarks as read."""
    return _recursive(nodes, """
WITH RECURSIVE walk AS (
  SELECT doc_id, node_id, title, page_index, 0 AS depth, array(cast(ordinal AS bigint)) AS place, array(node_id) AS path FROM {t} WHERE parent_id IS NULL
  UNION ALL
  SELECT c.doc_id, c.node_id, c.title, c.page_index, w.depth + 1, array_append(w.place, cast(c.ordinal AS bigint)), array_append(w.path, c.node_id)
  FROM walk w JOIN {t} c ON c.doc_id = w.doc_id AND c.parent_id = w.node_id WHERE NOT array_contains(w.path, c.node_id))
SELECT doc_id, node_id, title, coalesce(page_index, -1) AS page_index, depth, place FROM walk""")


def page_tree(nodes: DataFrame) -> DataFrame:
    """(doc_id, page_index, node_id, rotate) of page-tree nodes (doc_id, node_id, parent_id, ordinal, is_page, rotate): leaves in depth-first order, rotation inherited."""
    return _recursive(nodes, """
WITH RECURSIVE walk AS (
  SELECT doc_id, node_id, is_page, coalesce(rotate, 0) AS rotate, array(cast(ordinal AS bigint)) AS place, array(node_id) AS path FROM {t} WHERE parent_id IS NULL
  UNION ALL
  SELECT c.doc_id, c.node_id, c.is_page, coalesce(c.rotate, w.rotate), array_append(w.place, cast(c.ordinal AS bigint)), array_append(w.path, c.node_id)
  FROM walk w JOIN {t} c ON c.doc_id = w.doc_id AND c.parent_id = w.node_id WHERE NOT array_contains(w.path, c.node_id))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS page_index, node_id, rotate FROM walk WHERE is_page""")
