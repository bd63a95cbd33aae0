"""Vendor kits of nested documents and lines, source by source."""

import json

import pytest

from cloakframe.functions.tokens import Keys
from cloakframe.operators import classify, nested
from cloakframe.operators.kits import KITS
from cloakframe.plans import jobs

KEYS = Keys.derive(b"n" * 32, "nested")


def deep(name, value, arrays=False):
    for part in reversed(name.split(".")):
        value = {part: value}
        value = {part: [value[part]]} if arrays and isinstance(value[part], dict) else value
    return value


@pytest.mark.parametrize("arrays", [False, True])
def test_every_kit_is_told_from_nested_paths(spark, arrays):
    rows = [(k.id, json.dumps({"_source": deep(f, "x", arrays)})) for k in KITS.values() for f in k.fingerprints]
    rows += [("none", '{"a": {"b": 1}}'), ("one", json.dumps(deep("useridentity.arn", "x"))), ("bad", "{no json"), (None, None), ("empty", "")]
    got = {r.by: r for r in nested.detect(spark.createDataFrame(rows, "source string, value string"), "value", "json", "source").collect()}
    want = {k.id: classify.detect_kit([f"_source.{f}" for f in k.fingerprints]) for k in KITS.values()}
    assert {i: (got[i].kit, got[i].confidence, got[i].n_prints, got[i].weight) for i in want} == want and set(want) == {w[0] for w in want.values()}
    assert [got[i].kit for i in ("none", "one", "bad", None, "empty")] == [None] * 5 and len(got) == len(KITS) + 5 and got["one"].n_prints == 1


def test_containers_count_and_depth_is_linear():
    assert {"threatsinfomap", "threatsinfomap.threat", "threat"} <= set(nested.forms("_source.threatsInfoMap[].threat"))
    long = ".".join(f"k{i}" for i in range(3000))
    assert len(nested.forms(long)) < 3100 and "k2999" in nested.forms(long)


def test_documents_take_the_rules_of_their_source(spark):
    tell = {"resource_name": "pc1", "plan_name": "daily", "protection_plan": "p"}
    rows = [("a", json.dumps({"x": [tell | {"initiator": "ann.ross"}]})), ("b", '{"initiator": "ann.ross", "severity": 3}'), (None, '{"initiator": "ann.ross"}')]
    masked, _ = jobs.mask_json(spark.createDataFrame(rows, "source string, value string"), KEYS, by="source")
    got = {r.source: json.loads(r.value) for r in masked.collect()}
    assert masked.columns == ["source", "value"] and got["a"]["x"][0]["initiator"].startswith("usr-") and got["a"]["x"][0]["plan_name"] == "daily"
    assert got["b"] == {"initiator": "[ELIDED]", "severity": 3} and got[None] == {"initiator": "[ELIDED]"}


def test_lines_take_the_rules_of_their_source(spark):
    head = "CEF:0|Acme|Prod|1|5|"
    rows = [("a", head + "scan by ann@example.com|5|resource_name=pc1 plan_name=daily protection_plan=p"), ("a", head + "x|5|initiator=ann.ross msg=mail eve@example.com now note=second eve@example.com")]
    rows += [("b", head + "x|5|initiator=ann.ross severity=3"), ("b", None)] + [("c", head + f"x|5|free{i}=v{i}") for i in range(40)]  # keys that are data
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, source string, value string")
    masked, vault_rows = jobs.mask_lines(df, "cef", KEYS, by="source")
    got = {r.id: r.value for r in masked.collect()}
    assert masked.columns == df.columns and "initiator=usr-" in got[1] and "plan_name=daily" in got[0] and "ann@" not in got[0] and "eve@" not in got[1] and " now note=second " in got[1]
    assert got[2] == head + "x|5|initiator=[ELIDED] severity=3" and got[3] is None and all(f"free{i}=[ELIDED]" in got[4 + i] for i in range(40))
    back = {r.id: r.value for r in jobs.restore_lines(masked.where("id < 2"), "cef", vault_rows, KEYS, "id").collect()}
    assert "initiator=ann.ross" in back[1] and "eve@example.com now" in back[1]
