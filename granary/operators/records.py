"""Deeply nested records to flat tables that keep parent-child links (problem 2).

Method: Merkle subtree identities. A payload is parsed once; each object, list
and value is canonicalised (members by name) and hashed bottom-up, so that equal
subtrees have equal identities wherever they stand. Three tables result:

* ``roots(record_id, source, node, kind, quoted)``: the root identity of each record;
* ``nodes(node, kind, value)``: each distinct node once; value is a text, or the
  canonical JSON of a number or truth value (kind ``literal``);
* ``bridge(parent, member, pos, child, kind, quoted)``: each distinct node's links
  to its members, with member name (objects), 1-based place (lists), the child's
  kind, and whether the child stood as JSON in a string, once for each distinct
  parent. A record's occurrences are the paths from its root, so that every
  occurrence is preserved although nothing is stored twice.

Flat tables are walks from the roots (``walk``): all paths go down together, one
join with the bridge a level. Identities are 16 bytes. Repetitions are dropped
within each Arrow batch before the shuffle, then by key.

A text that holds JSON of an object or list counts as that. Payloads that are
null or not complete JSON (cut short, trailing text, NaN) give no rows. Of equal
member names the last holds. Equal rows count once.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.plans.staging import stage

TEXT, LITERAL, LIST, OBJECT, NULL = "text", "literal", "list", "object", "null"


def _refuse(name: str) -> None:
    raise ValueError(name)


def _parse(text: str):
    return json.loads(text, parse_constant=_refuse)


def _unwrap(x):
    """JSON of an object or list held in a string, at any depth of quoting, counts as that JSON."""
    y = x
    while isinstance(y, str) and y.lstrip()[:1] in ("{", "[", '"'):
        try:
            y = _parse(y)
        except (ValueError, RecursionError):
            return x
    return y if isinstance(y, (dict, list)) else x


class Shredder:
    """Nodes and links of the payloads of one batch, as columns; each distinct node is added once."""

    def __init__(self) -> None:
        self.kinds: dict[bytes, str] = {}
        self.leaves: dict[tuple, bytes] = {}  # by type and value, so that a frequent one is hashed once
        self.nodes: tuple[list, ...] = ([], [], [])  # node, kind, value
        self.links: tuple[list, ...] = ([], [], [], [], [], [])  # parent, member, pos, child, kind, quoted

    def add(self, x) -> tuple[bytes, str, bool]:
        """Add a value's subtree; its identity, its kind and whether it was quoted."""
        y = _unwrap(x) if isinstance(x, str) else x
        if isinstance(y, dict):
            names = sorted(y)
            below = [self.add(y[k]) for k in names]
            parts = [b"o"]
            for k, (child, _, quoted) in zip(names, below):
                name = k.encode("utf-8", "surrogatepass")
                parts += (b"q" if quoted else b"p", len(name).to_bytes(4), name, child)
            node, new = self._node(OBJECT, None, b"".join(parts))
            if new and names:
                self._link(node, names, [0] * len(names), below)
            return node, OBJECT, y is not x
        if isinstance(y, list):
            below = [self.add(v) for v in y]
            node, new = self._node(LIST, None, b"a" + b"".join((b"q" if quoted else b"p") + child for child, _, quoted in below))
            if new and below:
                self._link(node, [None] * len(below), range(1, len(below) + 1), below)
            return node, LIST, y is not x
        kind = NULL if y is None else TEXT if isinstance(y, str) else LITERAL
        known = self.leaves.get((type(y), repr(y) if isinstance(y, float) else y))
        if known is None:
            value = y if kind != LITERAL else json.dumps(y)
            known, _ = self._node(kind, value, b"n" if y is None else (b"s" if kind == TEXT else b"l") + value.encode("utf-8", "surrogatepass"))
            self.leaves[type(y), repr(y) if isinstance(y, float) else y] = known
        return known, kind, False

    def _node(self, kind: str, value: str | None, content: bytes) -> tuple[bytes, bool]:
        node = hashlib.blake2b(content, digest_size=16).digest()
        if node in self.kinds:
            return node, False
        self.kinds[node] = kind
        for column, v in zip(self.nodes, (node, kind, value)):
            column.append(v)
        return node, True

    def _link(self, node: bytes, names, places, below: list[tuple[bytes, str, bool]]) -> None:
        parent, member, pos, child, kind, quoted = self.links
        parent += [node] * len(below)
        member += names
        pos += places
        for c, k, q in below:
            child.append(c)
            kind.append(k)
            quoted.append(q)


def _shred_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["row", "a", "name", "pos", "b", "kind", "value", "quoted"]
    kinds = (pa.string(), pa.binary(), pa.string(), pa.int32(), pa.binary(), pa.string(), pa.string(), pa.bool_())
    for b in batches:
        s = Shredder()
        roots: dict[tuple, None] = {}
        for record, source, payload in zip(*(c.to_pylist() for c in b.columns)):
            try:
                x = _parse(payload)
            except (ValueError, RecursionError):
                continue
            roots[(record, source, *s.add(x))] = None
        n, m, r = len(s.nodes[0]), len(s.links[0]), len(roots)
        if not r:
            continue
        record, source, node, kind, quoted = map(list, zip(*roots))
        none = [None]
        columns = (
            ["root"] * r + ["node"] * n + ["link"] * m, none * r + s.nodes[0] + s.links[0], record + none * n + s.links[1], [0] * (r + n) + s.links[2],
            node + none * n + s.links[3], kind + s.nodes[1] + s.links[4], source + s.nodes[2] + none * m, quoted + [False] * n + s.links[5])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)


def merkle(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(roots, nodes, bridge) of ``records(record_id, source, payload)``."""
    some = records.select("record_id", "source", "payload").where("record_id is not null and payload is not null")
    rows = some.mapInArrow(_shred_batches, "row string, a binary, name string, pos int, b binary, kind string, value string, quoted boolean")
    rows = stage(rows.distinct(), "p2-merkle", by="row")
    of = lambda row, *c: rows.where(F.col("row") == row).select(*c)
    return (
        of("root", F.col("name").alias("record_id"), F.col("value").alias("source"), F.col("b").alias("node"), "kind", "quoted"),
        of("node", F.col("a").alias("node"), "kind", "value"),
        of("link", F.col("a").alias("parent"), F.col("name").alias("member"), "pos", F.col("b").alias("child"), "kind", "quoted"),
    )


# the steps of a path: to a member, to each member (its name is taken), to each item of a list (its place is taken; anything
# else is a list of itself), to a member where the node is an object (other nodes stay)
MEMBER, MEMBERS, ITEMS, OWN = "member", "members", "items", "own"
Step = tuple[str, str | None]


def walk(roots: DataFrame, bridge: DataFrame, paths: dict[str, list[Step]]) -> DataFrame:
    """(record_id, source, path, taken, node): where each path ends, with the names and places taken on the way.

    All paths go down together: a level is one join of the frontier with those
    links of the bridge that some path asks for. Rows that have arrived join on a
    key of their own record, so that frequent leaves make no hot key.
    """
    names = list(paths)
    depth = max(map(len, paths.values()))

    def by_path(column: str, values: list) -> Column:
        out = F.lit(None).cast(column)
        for i, v in enumerate(values):
            out = F.when(F.col("path") == i, F.lit(v).cast(column)).otherwise(out)
        return out

    x = roots.select("record_id", "source", "node", "kind", F.array().cast("array<string>").alias("taken"),
                     F.explode(F.array(*(F.lit(i) for i in range(len(names))))).alias("path"))
    for level in range(depth):
        steps = [paths[n][level] if level < len(paths[n]) else (None, None) for n in names]
        op, want = by_path("string", [s[0] for s in steps]), by_path("string", [s[1] for s in steps])
        x = x.withColumn("op", op).withColumn("want", want)
        single = (F.col("op") == ITEMS) & (F.col("kind") != LIST)
        stays = F.col("op").isNull() | single | ((F.col("op") == OWN) & (F.col("kind") != OBJECT))
        x = x.withColumn("taken", F.when(single, F.concat("taken", F.array(F.lit("1")))).otherwise(F.col("taken")))
        key = F.when(stays, F.encode(F.concat(F.lit("-"), "record_id"), "utf-8")).otherwise(F.col("node"))
        x = x.withColumn("stays", stays).withColumn("key", key)
        asked = [s for s in steps if s[0]]
        wanted = F.lit(False)
        for o, name in asked:
            wanted = wanted | (F.col("member").isNull() if o == ITEMS else F.col("member").isNotNull() if o == MEMBERS else F.col("member") == name)
        links = bridge.where(wanted).select("parent", "member", "pos", "child", F.col("kind").alias("child_kind"))
        fits = F.when(F.col("op") == ITEMS, F.col("member").isNull()).when(F.col("op") == MEMBERS, F.col("member").isNotNull()).otherwise(
            F.col("member") == F.col("want"))
        x = x.join(links, (F.col("key") == F.col("parent")) & fits, "left").where(F.col("stays") | F.col("child").isNotNull())
        more = F.when(F.col("child").isNotNull() & F.col("op").isin(ITEMS, MEMBERS), F.coalesce("member", F.col("pos").cast("string")))
        x = x.select(
            "record_id", "source", "path", F.coalesce("child", "node").alias("node"), F.coalesce("child_kind", "kind").alias("kind"),
            F.when(more.isNotNull(), F.concat("taken", F.array(more))).otherwise(F.col("taken")).alias("taken"),
        )
    return x.select("record_id", "source", by_path("string", names).alias("path"), "taken", "node")


# a payload that is itself a list holds one record or several
PATHS: dict[str, list[Step]] = {
    "steps": [(ITEMS, None), (MEMBER, "results_by_category"), (MEMBERS, None), (ITEMS, None), (MEMBER, "execution_path"), (ITEMS, None), (OWN, "node")],
    "files": [(ITEMS, None), (MEMBER, "pdf_data"), (ITEMS, None), (MEMBER, "metadata"), (MEMBER, "filename")],
    "alone": [(ITEMS, None), (MEMBER, "daily_units"), (ITEMS, None), (MEMBER, "precipitation_sum"), (ITEMS, None)],
    "bundled": [(ITEMS, None), (MEMBERS, None), (ITEMS, None), (MEMBER, "daily_units"), (ITEMS, None), (MEMBER, "precipitation_sum"), (ITEMS, None)],
}


def flat_leaves(roots: DataFrame, nodes: DataFrame, bridge: DataFrame) -> DataFrame:
    """(record_id, relation, parent, pos, item_value): the leaves of the three flat tables."""
    x = walk(roots, bridge, PATHS)
    leaves = nodes.where(F.col("kind").isin(TEXT, LITERAL)).select(F.col("node").alias("leaf"), F.col("value").alias("item_value"))
    x = x.join(leaves, F.col("node") == F.col("leaf"))
    taken = lambda i: F.get("taken", F.lit(i))
    path = F.col("path")
    relation = F.when(path == "steps", "execution_step").when(path == "files", "pdf_file").otherwise("daily_unit")
    parent = F.when(path == "steps", F.concat_ws("/", taken(1), taken(2))).when(path == "files", "").when(
        path == "alone", F.coalesce("source", F.lit(""))).otherwise(taken(1))
    pos = F.when(path == "steps", taken(3)).when(path == "files", taken(1)).otherwise("1").cast("int")
    return x.select("record_id", relation.alias("relation"), parent.alias("parent"), pos.alias("pos"), "item_value").distinct()
