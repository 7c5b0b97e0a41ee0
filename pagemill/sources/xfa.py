"""Form templates in XML: their nodes as rows, path lookup, and their scripts run in the order of a form's events."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions import formcalc, jsengine
from pagemill.sources.pdf import Malformed

_NODES = ("subform", "subformSet", "field", "draw", "exclGroup", "area", "pageSet", "pageArea", "contentArea")
_VALUED = ("field", "exclGroup", "draw")
_REFERENCE = re.compile(r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*")
_SUFFIX = re.compile(r"\.(?:rawValue|value)$")
_PREFIX = re.compile(r"^(?:\$record|\$form|xfa\.form|\$)\.")
MOST_NODES, DEEPEST = 200_000, 256
AT_ONCE = 4096  # rows that Python makes before they go on


@dataclass
class Node:
    node_id: int
    parent_id: int | None
    ordinal: int
    kind: str
    name: str | None
    path: str
    value: str | None
    attributes: dict[str, str]
    most: int | None = 1
    least: int = 1
    scripts: list[tuple[str, str, str]] = field(default_factory=list)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


@lru_cache(4096)
def _path(reference: str) -> str:
    """A reference less what it starts and ends with beside names."""
    return _PREFIX.sub("", _SUFFIX.sub("", reference))


@lru_cache(1024)
def _references(source: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(_REFERENCE.findall(source)))


def _language(script) -> str:
    return "javascript" if "javascript" in script.get("contentType", "").lower() else "formcalc"


def parse(xml: bytes | str) -> list[Node]:
    """A template's nodes in document order. Paths are the names from the root, those without a name left out. Documents that declare entities are refused."""
    if isinstance(xml, bytes):
        xml = xml.decode("utf-8-sig")
    if "<!ENTITY" in xml or "<!DOCTYPE" in xml:
        raise Malformed("a template declares no entities")
    try:
        root = ElementTree.fromstring(re.sub(r"^\s*<\?xml[^>]*\?>", "", xml))
    except ElementTree.ParseError as e:
        raise Malformed(f"template: {e}") from e
    if _local(root.tag) != "template":
        root = next((x for x in root.iter() if _local(x.tag) == "template"), None)
        if root is None:
            raise Malformed("no template")
    out: list[Node] = []
    stack: list = [(x, None, "", k, 0) for k, x in reversed(list(enumerate(root)))]
    while stack:
        x, above, path, ordinal, depth = stack.pop()
        kind = _local(x.tag)
        if kind not in _NODES:
            continue
        if depth > DEEPEST or len(out) >= MOST_NODES:
            raise Malformed("a template of too many nodes")
        name = x.get("name")
        here = ".".join(p for p in (path, name) if p)
        node = Node(len(out), above, ordinal, kind, name, here, None, dict(x.attrib))
        out.append(node)
        for child in x:
            what = _local(child.tag)
            if what == "value" and kind in _VALUED:
                node.value = "".join(child.itertext()).strip() or None
            elif what == "occur":
                node.least = int(child.get("min", 1))
                node.most = None if child.get("max", "1") == "-1" else int(child.get("max", 1))
            elif what in ("event", "calculate", "validate"):
                activity = child.get("activity", "click") if what == "event" else what
                node.scripts += [(activity, _language(s), "".join(s.itertext())) for s in child if _local(s.tag) == "script"]
        stack += [(child, node.node_id, here, k, depth + 1) for k, child in reversed(list(enumerate(x)))]
    return out


class Form:
    """A template's values while scripts run over them."""

    def __init__(self, nodes: list[Node]):
        self.nodes = nodes
        self.values: dict[int, object] = {n.node_id: n.value for n in nodes if n.kind in _VALUED}
        self.by_path: dict[str, int] = {}
        self.by_name: dict[str, int] = {}
        for n in nodes:
            self.by_path.setdefault(n.path, n.node_id)
            if n.name and n.kind in _VALUED:
                self.by_name.setdefault(n.name, n.node_id)

    def resolve(self, reference: str, context: int | None = None) -> int | None:
        """The node that a path names: from the root, else from the context and what it lies in, else below any subform, else by its last name."""
        path = _path(reference)
        if path in ("this", "$"):
            return context
        if path in self.by_path:
            return self.by_path[path]
        at = context
        while at is not None:
            inner = self.by_path.get(f"{self.nodes[at].path}.{path}")
            if inner is not None:
                return inner
            at = self.nodes[at].parent_id
        for n in self.nodes:
            if n.kind == "subform" and f"{n.path}.{path}" in self.by_path:
                return self.by_path[f"{n.path}.{path}"]
        return self.by_name.get(path.rpartition(".")[2])

    def run(self, node: Node, language: str, source: str):
        """The script's value; what it assigns to nodes is kept. Whatever is wrong with a script is a ScriptError."""
        named: dict[str, int] = {}
        for r in _references(source):
            while r:  # what stands behind a node's path is one of its properties or methods
                at = self.resolve(r, node.node_id)
                if at in self.values:
                    named[_SUFFIX.sub("", r)] = at
                    break
                r = r.rpartition(".")[0]
        given = {r + end: self.values[at] for r, at in named.items() for end in ("", ".rawValue", ".value")}
        try:
            out, after = (jsengine.run if language == "javascript" else formcalc.interpret)(source, given)
        except formcalc.ScriptError:
            raise
        except (TypeError, ValueError, OverflowError, RecursionError, KeyError, IndexError) as e:
            raise formcalc.ScriptError(str(e)) from e
        for r, value in after.items():
            at = named.get(_SUFFIX.sub("", r))
            if at is not None and value != given.get(r):
                self.values[at] = value
        return out

    def fire(self, activity: str) -> None:
        """Runs every script of an activity in document order; one that fails changes nothing. A calculation without an assignment is its node's value."""
        for node in self.nodes:
            for what, language, source in node.scripts:
                if what != activity:
                    continue
                before = dict(self.values)
                try:
                    out = self.run(node, language, source)
                except formcalc.ScriptError:
                    self.values = before
                    continue
                if activity == "calculate" and node.node_id in self.values and self.values == before and out is not None:
                    self.values[node.node_id] = out

    def invalid(self) -> list[int]:
        """Nodes whose validation is false. A script that fails is false in the form language and passes in JavaScript, as does one there without a value."""
        out = []
        for node in self.nodes:
            for what, language, source in node.scripts:
                if what != "validate":
                    continue
                before = dict(self.values)
                try:
                    said = self.run(node, language, source)
                    bad = not formcalc._truth(said) and not (language == "javascript" and said is None)
                except formcalc.ScriptError:
                    bad = language != "javascript"
                self.values = before
                if bad:
                    out.append(node.node_id)
        return out

    def text(self, node: int) -> str | None:
        value = self.values.get(node)
        return None if value is None else formcalc._text(value)


def bind(form: Form, data: str | None) -> None:
    """Values of a data document put where their names lead: by path, less the document's own root where that is not the form's."""
    if not data:
        return
    if "<!ENTITY" in data or "<!DOCTYPE" in data:
        raise Malformed("data declares no entities")
    root = ElementTree.fromstring(data)
    stack = [(root, "")]
    while stack:
        x, path = stack.pop()
        here = ".".join(p for p in (path, _local(x.tag)) if p)
        if len(x):
            stack += [(c, "" if _local(x.tag) in ("datasets", "data") else here) for c in reversed(x)]
        else:
            at = form.resolve(here)
            if at in form.values:
                form.values[at] = (x.text or "").strip()


_RELATIONS = {
    "nodes": "node_id int, parent_id int, ordinal int, kind string, name string, path string, value string, x string, y string, w string, h string, layout string, least int, most int",
    "scripts": "node_id int, path string, activity string, language string, source string",
    "values": "node_id int, path string, value string, valid boolean",
}


def _rows(what: str, xml, data) -> Iterator[tuple]:
    nodes = parse(xml)
    if what == "nodes":
        for n in nodes:
            yield n.node_id, n.parent_id, n.ordinal, n.kind, n.name, n.path, n.value, *(n.attributes.get(a) for a in ("x", "y", "w", "h", "layout")), n.least, n.most
    elif what == "scripts":
        for n in nodes:
            for activity, language, source in n.scripts:
                yield n.node_id, n.path, activity, language, source
    else:
        form = Form(nodes)
        bind(form, data)
        form.fire("initialize")
        form.fire("calculate")
        bad = set(form.invalid())
        for n in nodes:
            if n.kind in ("field", "exclGroup"):
                yield n.node_id, n.path, form.text(n.node_id), n.node_id not in bad


def relation(templates: DataFrame, what: str, id_col: str = "doc_id", xml_col: str = "template", data_col: str | None = None) -> DataFrame:
    """One of nodes, scripts and values (after data are bound and the events initialize, calculate and validate) of templates (id, XML).

    Narrow: one template at a time. A template that can't be read gives no rows; a script that fails changes nothing.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = f"{id_col} {templates.schema[id_col].dataType.simpleString()}, {_RELATIONS[what]}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t.type) for k, t in enumerate(arrow)], schema=arrow)

    def read(batches):
        for batch in batches:
            rows = []
            for doc, xml, data in zip(*batch.columns, strict=True):
                doc, xml = doc.as_py(), xml.as_py()
                try:
                    rows += [(doc, *r) for r in _rows(what, xml, data.as_py())] if xml is not None else []
                except (Malformed, ElementTree.ParseError, ValueError):
                    continue
                if len(rows) >= AT_ONCE:
                    yield made(rows)
                    rows = []
            if rows:
                yield made(rows)

    data = F.col(data_col) if data_col else F.lit(None).cast("string")
    return templates.select(F.col(id_col), F.col(xml_col), data.alias("_data")).mapInArrow(read, schema)


def paginated(nodes: DataFrame, room: float) -> DataFrame:
    """(doc_id, path, page, y): a template's fields, in document order, flowed into pages whose content area is `room` points high. A field without a height takes none."""
    from pagemill.functions import geometry
    from pagemill.operators import pages

    fields = nodes.where("kind IN ('field', 'draw')").select("doc_id", "path", F.col("node_id").cast("bigint").alias("at"), F.coalesce(geometry.points_of(F.col("h")), F.lit(0.0)).alias("high"))
    return pages.paginate(fields, "doc_id", "at", "high", room).select("doc_id", "path", "page", "y")


def _found(nodes: list[tuple], references: list[tuple]) -> Iterator[tuple[str | None, str | None]]:
    """(found, how) of each reference (ref, context) among a template's nodes (node_id, kind, name, path)."""
    nodes = sorted((n for n in nodes if n[0] is not None), key=lambda n: n[0])
    paths = {path for *_, path in nodes if path is not None}
    forms = {path for _, kind, _, path in nodes if kind == "subform" and path is not None}
    below: dict[str, str] = {}  # every way that a path ends below some subform: the first node with it
    leaf: dict[str, str] = {}
    for _, kind, name, path in nodes:
        if kind in _VALUED and name is not None and path is not None:
            leaf.setdefault(name, path)
        at = path.find(".") if path else -1
        while at >= 0:
            if path[:at] in forms:
                below.setdefault(path[at + 1 :], path)
            at = path.find(".", at + 1)
    for ref, context in references:
        path = None if ref is None else _path(ref)
        at = path if context is None else context if path is None else f"{context}.{path}"
        last = None if path is None else path.rpartition(".")[2]
        if path in paths:
            yield path, "root"
        elif at in paths:
            yield at, "context"
        elif path in below:
            yield below[path], "subform"
        else:
            yield leaf.get(last), "leaf" if last in leaf else None


def resolved(references: DataFrame, nodes: DataFrame) -> DataFrame:
    """references (doc_id, ref, context, ...) with found, the path of the node each names (null if none), and how: root, context, subform or leaf.

    context is the path of a subform. The first of several nodes with a path, or a name, in document order counts. One
    shuffle by document, of nodes and references together; a template's nodes are looked up in memory, one template at a
    time. Nothing is broadcast.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in references.schema) + ", found string, how string"
    node = F.struct("node_id", "kind", "name", "path")
    mine = nodes.where("doc_id IS NOT NULL").select("doc_id", node.alias("_n"))
    asked = references.select("doc_id", F.struct("*").alias("_r"))
    both = mine.unionByName(asked, allowMissingColumns=True).groupBy("doc_id").agg(F.collect_list("_n").alias("_n"), F.collect_list("_r").alias("_r"))

    def run(batches):
        for batch in batches:
            listed, given = batch.column("_n"), batch.column("_r")
            for i in range(batch.num_rows):
                rows = given[i].values
                if not len(rows):
                    continue
                pairs = zip(rows.field("ref").to_pylist(), rows.field("context").to_pylist(), strict=True)
                mine = listed[i].values
                answers = list(_found(list(zip(*(mine.field(k).to_pylist() for k in range(4)), strict=True)), list(pairs)))
                columns = [rows.field(k) for k in range(rows.type.num_fields)] + [pa.array([a[k] for a in answers], pa.string()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in rows.type), "found", "how"])

    return both.where(F.size("_r") > 0).select("_n", "_r").mapInArrow(run, schema)
