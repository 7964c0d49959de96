"""Deeply nested records to related flat tables, by shared inlining.

The schema graph of the records (element types are member names) is derived
from all of them.  An element type gets a table of its own if it is repeated,
shared (below more than one type) or closes a recursion; every other one is
inlined into its parent's table as dotted columns.  Each row has the id of its
record, its own id, and its parent's table and id.  A list in a list of member
m is a row of m, and its items are rows of a table ``m[]``.

An id is the dotted list of the ordinals of the repeated elements above it, so
ids tell positions, and a parent's id is a prefix of its children's.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minespark.scratch import materialize
from minespark.sources.nested_json import decode

ROOT = "record"
ROW_SCHEMA = "table_name string, id string, parent_table string, parent_id string, ordinal int, fields map<string,string>"


@dataclass
class Plan:
    """Which element types have tables, and the columns of each."""

    tables: list[str]
    columns: dict[str, list[str]] = field(default_factory=dict)
    graph: dict[str, dict[str, bool]] = field(default_factory=dict)


def _roots(value, envelopes: Sequence[str]) -> list:
    """The list of root objects in a decoded record: envelopes and lists around them are opened."""
    if isinstance(value, list):
        out: list = []
        for v in value:
            inner = _roots(v, envelopes) if isinstance(v, (dict, list)) else [None]
            out += inner or [None]
        return out
    if isinstance(value, dict):
        for e in envelopes:
            if isinstance(value.get(e), (dict, list)):
                return _roots(value[e], envelopes)
        return [value]
    return []


def _edges_of(obj: dict, kind: str, seen: set) -> None:
    todo = [(obj, kind)]
    while todo:
        x, k = todo.pop()
        for name, v in x.items():
            if isinstance(v, dict):
                seen.add((k, name, "object"))
                todo.append((v, name))
            elif isinstance(v, list):
                seen.add((k, name, "list"))
                lists = [(v, name)]
                while lists:
                    items, kind = lists.pop()
                    todo += [(i, kind) for i in items if isinstance(i, dict)]
                    inner = [(i, f"{kind}[]") for i in items if isinstance(i, list)]
                    if inner:
                        seen.add((kind, f"{kind}[]", "list"))
                        lists += inner
            else:
                seen.add((k, name, "null" if v is None else "scalar"))


def schema_graph(df: DataFrame, text: str, envelopes: Sequence[str] = (), max_edges: int = 5000) -> list[tuple[str, str, str]]:
    """The distinct (parent type, member, object|list|scalar|null) of all records.

    Raises ValueError beyond ``max_edges`` of them: then member names are data,
    and the records have no schema to be inlined.
    """

    def scan(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set = set()
        for b in batches:
            for t in b[text]:
                for r in _roots(decode(t), envelopes):
                    if r is not None:
                        _edges_of(r, ROOT, seen)
        yield pd.DataFrame(sorted(seen), columns=["parent", "member", "form"])

    got = df.select(text).mapInPandas(scan, "parent string, member string, form string").distinct().limit(max_edges + 1).collect()
    if len(got) > max_edges:
        raise ValueError(f"more than {max_edges} distinct members: not a schema")
    return sorted((r[0], r[1], r[2]) for r in got)


def _recursive(graph: dict[str, dict[str, bool]]) -> set[str]:
    """Types that can be reached from themselves."""
    out = set()
    for start in graph:
        todo, seen = list(graph[start]), set()
        while todo:
            n = todo.pop()
            if n == start:
                out.add(start)
                break
            if n not in seen:
                seen.add(n)
                todo += list(graph.get(n, ()))
    return out


def inlining_plan(edges: Sequence[tuple[str, str, str]]) -> Plan:
    """Shared inlining: tables for the root and for repeated, shared and, where a cycle has neither, recursive types."""
    graph: dict[str, dict[str, bool]] = {ROOT: {}}
    scalars: dict[str, set[str]] = defaultdict(set)
    elements = {m for _, m, f in edges if f in ("object", "list")}
    for parent, member, form in edges:
        if member in elements and form != "scalar":
            if form != "null":
                graph.setdefault(parent, {})
                graph.setdefault(member, {})
                graph[parent][member] = graph[parent].get(member, False) or form == "list"
        elif form != "null" or member not in elements:
            scalars[parent].add(member)
    parents: dict[str, set[str]] = defaultdict(set)
    for p, kids in graph.items():
        for k in kids:
            parents[k].add(p)
    own = {ROOT} | {k for kids in graph.values() for k, rep in kids.items() if rep} | {k for k, ps in parents.items() if len(ps) > 1}
    cyclic = _recursive(graph)
    for k in sorted(cyclic):  # a cycle that no table interrupts
        todo, seen, open_cycle = [c for c in graph[k] if c not in own], set(), False
        while todo and k not in own:
            n = todo.pop()
            if n == k:
                open_cycle = True
                break
            if n not in seen:
                seen.add(n)
                todo += [c for c in graph.get(n, ()) if c not in own or c == k]
        if open_cycle:
            own.add(k)
    plan = Plan(sorted(own), graph=graph)
    for t in plan.tables:
        cols, todo = [], [(t, "")]
        while todo:
            k, prefix = todo.pop()
            cols += [prefix + s for s in sorted(scalars.get(k, ()))]
            todo += [(c, f"{prefix}{c}.") for c in sorted(graph.get(k, ())) if c not in own]
        plan.columns[t] = sorted(cols) + ["value"] * (t != ROOT and "value" not in cols)
    return plan


def _text(v) -> str | None:
    return v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def _rows_of(root: dict, ordinal: int, own: set[str]) -> Iterator[tuple]:
    """The flat rows of one root object, parents before children."""
    todo = [(ROOT, root, str(ordinal), None, None, ordinal)]
    while todo:
        kind, obj, rid, ptable, pid, pos = todo.pop()
        fields: dict[str, str | None] = {}
        inner = [("", obj)]
        while inner:
            prefix, x = inner.pop()
            if isinstance(x, list):  # a list in a list
                todo += [(f"{kind}[]", i, f"{rid}.{n}", kind, rid, n) for n, i in enumerate(x)]
                continue
            if not isinstance(x, dict):  # a list of plain values
                fields[prefix + "value"] = _text(x)
                continue
            for name, v in x.items():
                if isinstance(v, list):
                    todo += [(name, i, f"{rid}.{n}", kind, rid, n) for n, i in enumerate(v)]
                elif isinstance(v, dict):
                    if name in own:
                        todo.append((name, v, rid, kind, rid, 0))
                    else:
                        inner.append((f"{prefix}{name}.", v))
                elif name not in own or v is not None:
                    fields[prefix + name] = _text(v)
        yield kind, rid, ptable, pid, pos, fields


def shred(df: DataFrame, key: str, text: str, envelopes: Sequence[str] = (), repeated: Sequence[str] = ()) -> tuple[Plan, DataFrame]:
    """The inlining plan and all flat rows (key + ROW_SCHEMA), written once, partitioned by table.

    ``repeated``: members that are lists by definition, so a lone object counts
    as a list of one wherever it occurs.  Members that are lists in some record
    and a lone object in another are repeated anyway.  Records without readable
    JSON (NULL, empty, cut off) have no rows.  Scalars are kept as text.  A key
    named like one of the rows' own columns is returned as ``record_<key>``.
    """
    if key in ("table_name", "id", "parent_table", "parent_id", "ordinal", "fields"):
        df, key = df.select(F.col(key).alias(f"record_{key}"), text), f"record_{key}"
    edges = schema_graph(df, text, envelopes)
    edges += [(p, m, "list") for p, m, f in edges if m in repeated and f == "object"]
    plan = inlining_plan(edges)
    own, lists = set(plan.tables), {k for kids in plan.graph.values() for k, rep in kids.items() if rep}

    def as_lists(x):  # a lone object of a repeated type becomes a list of one
        todo = [x]
        while todo:
            o = todo.pop()
            for name, v in o.items():
                if isinstance(v, dict):
                    if name in lists:
                        o[name] = [v]
                    todo.append(v)
                elif isinstance(v, list):
                    items = list(v)
                    while items:
                        i = items.pop()
                        if isinstance(i, dict):
                            todo.append(i)
                        elif isinstance(i, list):
                            items += i
        return x

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys, rows = [], []
            for k, t in zip(b[key], b[text]):
                for pos, r in enumerate(_roots(decode(t), envelopes)):
                    if r is not None:
                        new = list(_rows_of(as_lists(r), pos, own))
                        keys += [k] * len(new)
                        rows += new
                if len(rows) > 20_000:
                    yield _frame(key, keys, rows)
                    keys, rows = [], []
            yield _frame(key, keys, rows)

    schema = f"{key} {df.schema[key].dataType.simpleString()}, {ROW_SCHEMA}"
    return plan, materialize(df.select(key, text).mapInPandas(run, schema), ["table_name"])


def _frame(key: str, keys: list, rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["table_name", "id", "parent_table", "parent_id", "ordinal", "fields"])
    out.insert(0, key, keys)
    return out


def flat_table(plan: Plan, rows: DataFrame, key: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """One table: key, id, parent_table, parent_id, ordinal and its inlined columns (dots become underscores)."""
    cols = plan.columns.get(name, []) if columns is None else columns
    return rows.filter(F.col("table_name") == name).select(
        key, "id", "parent_table", "parent_id", "ordinal", *[F.element_at("fields", F.lit(c)).alias(c.replace(".", "_")) for c in cols]
    )
