"""Deeply nested documents as related flat tables (shared inlining).

1. The schema graph is analysed: every task walks its documents and counts
   (path, kind); counts are combined before they are gathered, so the driver
   receives one row a distinct path and kind, never documents.  Paths are
   arrays of field names, so names may hold any character.
2. Parts that occur once below their parent are inlined into it.  Parts that
   are repeated (arrays of objects, also where some documents hold a lone
   object or JSON text instead), shared by several parents, or recursive
   become tables: one for each element type, whatever paths lead to it.  Rows
   tell the path of their parent and its place.
3. Documents are parsed once, into VARIANT, and one pass makes the rows with
   JVM expressions only.
"""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_PATHS = 20_000  # distinct (path, kind)

Path = tuple[str, ...]


def _loads(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return None


def _nested(value, first: str):
    """What a text holds as JSON, if that is an object or array."""
    if isinstance(value, str) and value.lstrip()[:1] in first:
        inner = _loads(value)
        return inner if isinstance(inner, (dict, list)) else None
    return None


def _scalar(value) -> str:
    return "long" if isinstance(value, int) and not -(2**63) <= value < 2**63 else type(value).__name__


def _walk(value, path: Path, counts: Counter) -> None:
    inner = _nested(value, "{[") if value else None
    if inner is not None:
        counts[path, "text"] += 1
        value = inner
    if isinstance(value, dict):
        counts[path, "object"] += 1
        for k, v in value.items():
            _walk(v, (*path, k), counts)
    elif isinstance(value, list):
        objects = 0
        for v in value:
            inner = _nested(v, "{") if v else None
            if inner is not None:
                counts[path, "element text"] += 1
                v = inner
            if isinstance(v, dict):
                objects += 1
                counts[path, "element"] += 1
                for k, w in v.items():
                    _walk(w, (*path, k), counts)
            elif v is not None:
                counts[path, "other element"] += 1
        counts[path, "array" if objects else "list"] += 1
    elif value is None:
        counts[path, "null"] += 1
    else:
        counts[path, _scalar(value)] += 1


def _count_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            doc = _loads(text) if text else None
            if isinstance(doc, dict):
                _walk(doc, (), counts)
    keys = list(counts)
    yield pa.RecordBatch.from_arrays([pa.array([list(k[0]) for k in keys], pa.list_(pa.string())), pa.array([k[1] for k in keys], pa.string()), pa.array([counts[k] for k in keys], pa.int64())], names=["path", "kind", "n"])


def path_kinds(docs: DataFrame, doc: Column) -> DataFrame:
    """(path, kind, n) over all documents."""
    return docs.select(doc.cast("string").alias("doc")).mapInArrow(_count_paths, "path array<string>, kind string, n bigint").groupBy("path", "kind").agg(F.sum("n").alias("n"))


@dataclass
class SchemaGraph:
    """``tables``: table name to its columns, each a path below the table's
    rows; ``members``: the paths that lead to a table; ``why``: repeated,
    recursive or shared.  The root table has the name ``""``."""

    tables: dict[str, list[Path]]
    members: dict[str, list[Path]]
    why: dict[str, str]
    table_of: dict[Path, str]
    kinds: dict[Path, dict[str, int]]
    below: dict[Path, list[Path]] = field(default_factory=dict)

    def has(self, path: Path, *kinds: str) -> bool:
        return any(k in self.kinds.get(path, ()) for k in kinds)


def _ancestors(path: Path) -> Iterator[Path]:
    while path:
        path = path[:-1]
        yield path


def _element_types(nodes: set[Path], shape: dict[Path, frozenset]) -> list[list[Path]]:
    """Paths that lead to the same type of element: the same name with the
    same fields, or within one another with a field in common."""
    same: dict[Path, Path] = {p: p for p in nodes}

    def root(p: Path) -> Path:
        while same[p] != p:
            p = same[p]
        return p

    first: dict[tuple, Path] = {}
    for p in sorted(nodes):
        if shape[p]:
            same[root(p)] = root(first.setdefault((p[-1], shape[p]), p))
        for a in _ancestors(p):
            if a in nodes and a[-1] == p[-1] and (shape[a] & shape[p] or not shape[p]):
                same[root(p)] = root(a)
    groups: dict[Path, list[Path]] = defaultdict(list)
    for p in sorted(nodes):
        groups[root(p)].append(p)
    return list(groups.values())


SCALARS = {"str", "int", "long", "float", "bool"}


def analyse(kinds: Sequence[tuple[Sequence[str], str, int]]) -> SchemaGraph:
    by: dict[Path, dict[str, int]] = defaultdict(dict)
    for path, kind, n in kinds:
        by[tuple(path)][kind] = n
    nodes = {p for p, k in by.items() if p and ("object" in k or "element" in k)}
    shape = {p: frozenset() for p in nodes}
    fields: dict[Path, set[str]] = defaultdict(set)
    for q in by:
        if q:
            fields[q[:-1]].add(q[-1])
    shape = {p: frozenset(fields[p]) for p in nodes}
    table_of: dict[Path, str] = {(): ""}
    members: dict[str, list[Path]] = {"": [()]}
    why: dict[str, str] = {}
    for paths in _element_types(nodes, shape):
        if any("element" in by[p] for p in paths):
            reason = "repeated"
        elif any(a in paths for p in paths for a in _ancestors(p)):
            reason = "recursive"
        elif len(paths) > 1:
            reason = "shared"
        else:
            continue
        name = ".".join(paths[0]) if len(paths) == 1 else paths[0][-1]
        while name in members:
            name += "_"
        members[name], why[name] = paths, reason
        table_of.update({p: name for p in paths})
    below: dict[Path, list[Path]] = defaultdict(list)
    tables: dict[str, list[Path]] = {t: [] for t in members}
    for p in sorted(by):
        if not p:
            continue
        home = next(a for a in _ancestors(p) if a in table_of)
        if p in table_of:
            below[home].append(p)
        rel = p[len(home) :]
        # a part that is an object here and a scalar there is a column as well
        if (p not in nodes or SCALARS & set(by[p])) and p not in table_of and rel not in tables[table_of[home]]:
            tables[table_of[home]].append(rel)
    return SchemaGraph({t: sorted(c) for t, c in tables.items()}, members, why, table_of, dict(by), dict(below))


def schema_graph(docs: DataFrame, doc: Column) -> SchemaGraph:
    """Analyses all documents.  The result has one entry a distinct path and
    kind; more than MAX_PATHS means the keys are data, which this operator
    refuses."""
    found = path_kinds(docs, doc).limit(MAX_PATHS + 1).collect()
    if len(found) > MAX_PATHS:
        raise ValueError(f"more than {MAX_PATHS} distinct paths: field names seem to be data")
    return analyse([(r.path, r.kind, r.n) for r in found])


# ------------------------------------------------------------- expressions


def _field(v: Column, steps: Path, to: str = "variant") -> Column:
    """The field below a variant, null where there is none."""
    for k, s in enumerate(steps):
        if "'" in s and '"' in s:  # no path can name it
            inner = F.try_element_at(F.try_variant_get(_field(v, steps[:k]) if k else v, "$", "map<string,variant>"), F.lit(s))
            return _field(inner, steps[k + 1 :], to)
    if not steps:
        return v if to == "variant" else F.try_variant_get(v, "$", to)
    quoted = (f'"{s}"' if "'" in s else f"'{s}'" for s in steps)
    return F.try_variant_get(v, "$" + "".join(f"[{s}]" for s in quoted), to)


def _opened(v: Column) -> Column:
    """A part held as JSON text counts as if it were nested."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_parse_json(F.try_variant_get(v, "$", "string"))).otherwise(v)


def _part(v: Column, graph: SchemaGraph, base: Path, rel: Path, to: str = "variant") -> Column:
    """The part at ``base`` + ``rel`` below the variant of ``base``; texts are
    opened only where the analysis found some."""
    done = 0
    for k in range(1, len(rel) + 1):
        if graph.has(base + rel[:k], "text") and (k < len(rel) or to == "variant"):
            v, done = _opened(_field(v, rel[done:k])), k
    return _field(v, rel[done:], to)


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def _with(v: Column, rows: Callable[[Column], Column]) -> Column:
    """``rows(v)``, an array, with ``v`` computed once."""
    return F.flatten(F.transform(F.array(v), rows))


def _rows(graph: SchemaGraph, node: Path, obj: Column, index: Column, wanted: set[Path], carry: bool) -> list[Column]:
    """Arrays of (path, index, parent_path, parent_index, obj) for the parts below a node."""

    def child_of(child: Path) -> Column:
        def own(e: Column, place: Column) -> Column:
            row = F.struct(F.lit(".".join(child)).alias("path"), place.alias("index"), F.lit(".".join(node)).alias("parent_path"), index.alias("parent_index"), *([e.alias("obj")] if carry else []))
            rows = F.concat(F.array(row), *_rows(graph, child, e, place, wanted, carry))
            # only objects and nulls were found here, or each has to be looked at
            mixed = graph.has(child, "other element", "element text")
            there = _is_object(e) if mixed else e.isNotNull() & ~F.is_variant_null(e)
            return F.when(there, rows).otherwise(F.slice(F.array(row), 1, 0))

        def one(e: Column, i: Column) -> Column:
            place = F.when(index == "", i.cast("string")).otherwise(F.concat(index, F.lit("."), i.cast("string")))
            return _with(_opened(e), lambda x: own(x, place)) if graph.has(child, "element text") else own(e, place)

        def each(v: Column) -> Column:
            found = F.try_variant_get(v, "$", "array<variant>")
            if graph.has(child, "object"):
                found = F.when(_is_object(v), F.array(v)).otherwise(found)
            return F.flatten(F.transform(F.coalesce(found, F.array().cast("array<variant>")), one))

        return _with(_part(obj, graph, node, child[len(node) :]), each)

    return [child_of(c) for c in graph.below.get(node, []) if c in wanted]


def _parsed(docs: DataFrame, keys: Sequence[str], doc: Column) -> DataFrame:
    text = doc.cast("string")
    return docs.where(F.ltrim(text).startswith("{")).select(*keys, F.try_parse_json(text).alias("_doc")).where("_doc is not null")


def child_rows(docs: DataFrame, keys: Sequence[str], doc: Column, graph: SchemaGraph, paths: Sequence[Path] | None = None, with_object: bool = False) -> DataFrame:
    """(keys, path, index, parent_path, parent_index): one row for each object
    of a table below the document, with ``obj`` (VARIANT) on request.
    ``index`` holds the positions in the arrays passed, from 0, joined with
    ``.``; (keys, parent_path, parent_index) is the foreign key.  ``paths``
    picks some.  Documents that are null, malformed or no object, nulls within
    arrays and scalars in place of objects give no row."""
    chosen = [p for p in graph.table_of if p] if paths is None else [p for p in paths if p in graph.table_of]
    wanted = {a for p in chosen for a in (p, *_ancestors(p))}
    base = _parsed(docs, keys, doc)
    parts = _rows(graph, (), F.col("_doc"), F.lit(""), wanted, with_object)
    names = ["path", "index", "parent_path", "parent_index"] + (["obj"] if with_object else [])
    if not parts:
        return base.where("false").select(*keys, *[F.lit("").alias(c) for c in names[:4]], *([F.col("_doc").alias("obj")] if with_object else []))
    rows = base.select(*keys, F.explode(F.concat(*parts)).alias("_n"))
    rows = rows.select(*keys, *[f"_n.{c}" for c in names])
    return rows if paths is None else rows.where(F.col("path").isin([".".join(p) for p in chosen]))


def column_type(kinds: set[str]) -> str:
    """bigint, double or boolean where all values are such, else text."""
    found = kinds - {"null"}
    if found and found <= {"int"}:
        return "bigint"
    if found and found <= {"int", "float"}:
        return "double"
    return "boolean" if found == {"bool"} else "string"


def flat_table(docs: DataFrame, keys: Sequence[str], doc: Column, graph: SchemaGraph, name: str) -> DataFrame:
    """One table with its inlined fields as columns (named by their path below
    the table, dots as ``_``; a clash with a key column or another field gets
    a trailing ``_``); tables below the root with path, index, parent_path and
    parent_index.  Arrays of scalars are JSON text."""
    members = graph.members[name]
    links = [] if name == "" else ["path", "index", "parent_path", "parent_index"]
    rows = _parsed(docs, keys, doc).select(*keys, F.col("_doc").alias("obj")) if name == "" else child_rows(docs, keys, doc, graph, members, True)
    used, cols = {*keys, *links}, []
    for rel in graph.tables[name]:
        column = "_".join(rel).replace(".", "_").replace("$", "")
        while column in used:
            column += "_"
        used.add(column)
        kinds = {k for m in members for k in graph.kinds.get(m + rel, ())}
        to, value = column_type(kinds), None
        for m in members:
            if m + rel in graph.kinds:
                mine = _part(F.col("obj"), graph, m, rel, to)
                if kinds & {"object", "element"}:
                    raw = _part(F.col("obj"), graph, m, rel[:-1])
                    mine = F.when(~F.schema_of_variant(_field(raw, rel[-1:])).rlike("^(OBJECT|ARRAY)"), mine)
                value = mine if len(members) == 1 else F.when(F.col("path") == ".".join(m), mine) if value is None else value.when(F.col("path") == ".".join(m), mine)
        cols.append(value.alias(column))
    return rows.select(*keys, *links, *cols)


def inline(docs: DataFrame, keys: Sequence[str], doc: Column) -> dict[str, DataFrame]:
    """All tables by name; the root table has the name ``""``."""
    graph = schema_graph(docs, doc)
    return {t: flat_table(docs, keys, doc, graph, t) for t in graph.tables}
