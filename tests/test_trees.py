"""Nested JSON as rows against a walk over the parsed trees."""

import json

import pytest

from colloq.sources import messages, trees


def walk(tree, path="$", depth=0, drop=()):
    kind = "object" if isinstance(tree, dict) else "array" if isinstance(tree, list) else "null" if tree is None else "leaf"
    yield path, depth, kind, (str(tree).lower() if isinstance(tree, bool) else str(tree)) if kind == "leaf" else None
    for k, v in tree.items() if kind == "object" else enumerate(tree) if kind == "array" else ():
        if not (kind == "object" and k in drop):
            yield from walk(v, f"{path}.{k}" if kind == "object" else f"{path}[{k}]", depth + 1, drop)


TREES = [
    {"a": 1, "b_c": {"d": [1, "x", None, {"secret": 1, "e": True}], "secret": {"f": 2}}, "g": [], "h": {}},
    [[1, [2, [3, {"deep": {"deeper": "ü"}}]]], "s"], 5, None, "text", {"items": list(range(12))}, {"": {"x": ""}},
]


def test_nodes(spark):
    rows = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(TREES)] + [(90, None), (91, "{broken"), (92, "")], "id long, j string")
    for drop in ((), ("secret", "deep")):
        found = sorted(((r.id, r.path, r.depth, r.kind, r.value) for r in trees.nodes(rows, ["id"], "j", drop).collect()), key=str)
        assert found == sorted(((i, *n) for i, t in enumerate(TREES) for n in walk(t, drop=drop)), key=str)
    assert trees.leaves(trees.nodes(rows, ["id"], "j")).filter("id = 0").count() == 7
    with pytest.raises(ValueError):
        trees.nodes(rows, ["id"], "j", most=3)


def test_lookup_and_lines(spark):
    tree = {"b_c": {"d": 1, "list": list(range(11))}, "z": "end", "a": None}
    rows = spark.createDataFrame([(1, json.dumps(tree)), (2, "{"), (3, '{"b_c": 4}')], "id long, j string")
    assert [r[0] for r in rows.orderBy("id").select(trees.lookup("j", "b_c.d", "none")).collect()] == ["1", "none", "none"]
    assert messages.lookup(tree, "b_c.d") == 1
    found = {r.id: r.lines for r in trees.lines(trees.nodes(rows, ["id"], "j"), ["id"]).collect()}
    assert found[1].split("\n") == messages.flatten({"a": None, "b_c": {"d": 1, "list": list(range(11))}, "z": "end"}) and found[3] == "b c: 4"
