"""Records: Merkle tables against a plain walk, and the odd cases."""

import json

import pytest
from pyspark.sql import functions as F

from granary.operators import records
from granary.operators.records import _parse, _unwrap
from granary.plans import cleaning
from granary.sources.tables import table
from tests.helpers import SF_SMALL


def many(x):
    x = _unwrap(x)
    return x if isinstance(x, list) else [x]


def text(x):
    return x if isinstance(x, str) else json.dumps(x)


def walk(record, source, payload):
    """The leaves by a plain walk over the parsed payload."""
    try:
        x = _parse(payload)
    except ValueError:
        return
    for x in many(x):
        x = _unwrap(x)
        if not isinstance(x, dict):
            continue
        for category, cases in (_unwrap(x.get("results_by_category")) or {}).items():
            for i, case in enumerate(many(cases), 1):
                case = _unwrap(case)
                if isinstance(case, dict) and "execution_path" in case:
                    for pos, step in enumerate(many(case["execution_path"]), 1):
                        step = _unwrap(step)
                        step = step.get("node") if isinstance(step, dict) else step
                        if step is not None:
                            yield record, "execution_step", f"{category}/{i}", pos, text(step)
        if "pdf_data" in x:
            for pos, f in enumerate(many(x["pdf_data"]), 1):
                f = _unwrap(f)
                meta = _unwrap(f.get("metadata")) if isinstance(f, dict) else None
                if isinstance(meta, dict) and meta.get("filename") is not None:
                    yield record, "pdf_file", "", pos, text(meta["filename"])
        zones = {source or "": x} if "daily_units" in x else x
        for zone, z in zones.items():
            z = _unwrap(z)
            units = _unwrap(z.get("daily_units")) if isinstance(z, dict) else None
            if isinstance(units, dict) and units.get("precipitation_sum") is not None:
                yield record, "daily_unit", zone, 1, text(units["precipitation_sum"])


def test_leaves_match_a_plain_walk_on_whole_table(spark):
    raw = table(spark, SF_SMALL, "raw_records").select("record_id", "source_file", "payload").collect()
    want = {x for r in raw if r.payload is not None for x in walk(*r)}
    got = [tuple(r) for r in cleaning.p2_found(spark, SF_SMALL).collect()]
    assert len(got) == len(set(got))
    assert set(got) == want


def test_odd_payloads(spark):
    rows = [
        ("a", "s", None),
        ("b", "s", '{"pdf_data": {"metadata": {"filename": "x.pdf"}}'),  # cut short
        ("c", "s", '"{\\"pdf_data\\": [{\\"metadata\\": {\\"filename\\": null}}, {\\"metadata\\": {\\"filename\\": \\"y\\"}}]}"'),
        ("d", "s", '{"daily_units": {"precipitation_sum": NaN}}'),
        ("e", "s", '{"results_by_category": {"k": {"execution_path": "one"}}}'),
        ("e", "s", '{"results_by_category": {"k": {"execution_path": "one"}}}'),
        ("f", None, '{"daily_units": {"precipitation_sum": "mm"}}'),
        ("g", "s", "[]"),
    ]
    df = spark.createDataFrame(rows, "record_id string, source string, payload string").withColumn("node", F.lit("clash"))
    got = {tuple(r) for r in records.flat_leaves(*records.merkle(df)).collect()}
    assert got == {
        ("c", "pdf_file", "", 2, "y"), ("e", "execution_step", "k/1", 1, "one"), ("f", "daily_unit", "", 1, "mm"),
    }


def test_equal_subtrees_are_stored_once(spark):
    rows = [(str(i), "s", json.dumps({"u": {"a": 1, "b": [1, 2]}, "i": i})) for i in range(20)]
    roots, nodes, bridge = records.merkle(spark.createDataFrame(rows, "record_id string, source string, payload string"))
    assert roots.count() == 20
    assert nodes.count() == nodes.select("node").distinct().count()
    shared = bridge.where("member = 'u'").select("child").distinct()
    assert shared.count() == 1 and bridge.where("member = 'u'").count() == 20


@pytest.mark.parametrize("n", [0])
def test_empty_table(spark, n):
    empty = spark.createDataFrame([], "record_id string, source string, payload string")
    assert records.flat_leaves(*records.merkle(empty)).count() == n


def test_records_can_be_rebuilt(spark):
    """Nothing is lost: the tables give back every payload, quoted members too."""
    raw = table(spark, SF_SMALL, "raw_records").select("record_id", F.col("source_file").alias("source"), "payload").where("payload is not null").limit(150)
    roots, nodes, bridge = (x.collect() for x in records.merkle(raw))
    kinds, links = {bytes(n.node): n for n in nodes}, {}
    for b in bridge:
        links.setdefault(bytes(b.parent), []).append(b)

    def rebuilt(node):
        n = kinds[bytes(node)]
        children = links.get(bytes(node), [])
        if n.kind == "object":
            return {b.member: (b.quoted, rebuilt(b.child)) for b in children}
        if n.kind == "list":
            return [(b.quoted, rebuilt(b.child)) for b in sorted(children, key=lambda b: b.pos)]
        return None if n.kind == "null" else n.value if n.kind == "text" else json.loads(n.value)

    def flagged(x):
        y = _unwrap(x)
        value = {k: flagged(v) for k, v in y.items()} if isinstance(y, dict) else [flagged(v) for v in y] if isinstance(y, list) else y
        return (y is not x, value)

    got = {(r.record_id, r.source): (r.quoted, rebuilt(r.node)) for r in roots}
    n = 0
    for r in raw.distinct().collect():
        try:
            want = flagged(_parse(r.payload))
        except ValueError:
            continue
        n += 1
        assert got[r.record_id, r.source] == want or raw.where(F.col("record_id") == r.record_id).distinct().count() > 1
    assert n > 100
