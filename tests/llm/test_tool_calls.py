"""Tool-call linking: every status, levels, cycles, canonical JSON."""

import json
import random

import pytest

from flagloom.llm import toolcalls

CALLS = "conv_id long, call_id string, seq long, tool string, arguments string, parent_id string, status string"
RESULTS = "conv_id long, call_id string, seq long, content string, tool string"
SCHEMAS = [("f", "q", "string", True), ("f", "n", "integer", False), ("f", "x", "number", False),
           ("f", "o", "object", False), ("f", "a", "array", False), ("f", "b", "boolean", False), ("g", None, None, None)]


@pytest.fixture(scope="module")
def schemas(spark):
    return spark.createDataFrame(SCHEMAS, "tool string, param string, type string, required boolean")


def link(spark, schemas, calls, results):
    got = toolcalls.link_tool_calls(spark.createDataFrame([(*c, "clash") for c in calls], CALLS),
                                    spark.createDataFrame([(*r, "clash") for r in results], RESULTS), schemas)
    assert got.columns == ["conv_id", "call_id", "seq", "tool", "level", "n_results", "status", "errors", "record"]
    return got.collect()


def test_statuses(spark, schemas):
    ok = '{"q": "é\\"\\n/", "n": 2.0, "x": 1e2, "o": {"z": 1, "a": [null]}, "a": [], "b": true}'
    calls = [(1, "a", 0, "f", ok, None), (1, "b", 2, "f", '{"q":1, "n":1.5, "x":"1", "w":0}', "a"),
             (1, "c", 4, "f", "{}", "b"), (1, "d", 6, "f", '{"q":', "c"), (1, "e", 6, "f", None, None),
             (1, "e2", 6, "f", "[1]", None), (1, "e3", 6, "f", '{"q":"1","q":"2"}', None), (1, "h", 7, "nope", '{"q":"x"}', None),
             (1, "i", 8, "g", "{}", "zz"), (1, "j", 9, "g", '{"extra":1}', None), (1, "k", 9, "g", "{}", None),
             (1, "dup", 1, "g", "{}", None), (1, "dup", 2, "f", "{}", None), (1, "dup", 1, "g", "{}", None),
             (None, "a", 0, "g", "{}", None), (1, None, 0, "g", "{}", None), (2, "a", 0, "g", "{}", None),
             (3, "x", 0, "g", "{}", "y"), (3, "y", 0, "g", "{}", "x"), (3, "z", 0, "g", "{}", "x"), (3, "s", 0, "g", "{}", "s")]
    results = [(1, "a", 3, "late"), (1, "a", 1, "first"), (1, "b", 5, "r"), (1, "dup", 5, "d"), (9, "a", 1, "lost"),
               (9, "a", 2, "lost too"), (1, None, 1, "nobody"), (2, "a", 1, None)]
    got = {(r["conv_id"], r["call_id"], r["seq"]): r for r in link(spark, schemas, calls, results)}
    assert len(got) == 22
    status = {k: v["status"] for k, v in got.items()}
    assert status[1, "a", 0] == "ok" and got[1, "a", 0]["n_results"] == 2
    assert got[1, "a", 0]["record"] == (
        '{"arguments":{"a":[],"b":true,"n":2,"o":{"a":[null],"z":1},"q":"é\\"\\n/","x":100.0},"call_id":"a","conv_id":1,'
        '"parent_id":null,"result":"first","tool":"f"}')
    assert status[1, "b", 2] == "invalid" and got[1, "b", 2]["errors"] == ["type:n", "type:q", "type:x", "unknown:w"]
    assert got[1, "c", 4]["errors"] == ["missing:q"] and got[1, "c", 4]["level"] == 2
    assert {status[1, c, 6] for c in ("d", "e", "e2", "e3")} == {"bad_json"} and got[1, "d", 6]["level"] == 3
    assert status[1, "h", 7] == "unknown_tool" and status[1, "i", 8] == "unknown_parent"
    assert got[1, "j", 9]["errors"] == ["unknown:extra"] and status[1, "k", 9] == "no_result"
    assert status[1, "dup", 1] == "ok" and status[1, "dup", 2] == "duplicate_id"
    assert status[None, "a", 0] == status[1, None, 0] == "no_id"
    assert status[2, "a", 0] == "ok" and json.loads(got[2, "a", 0]["record"])["result"] is None
    assert {status[3, c, 0] for c in "xyzs"} == {"cycle"} and got[3, "z", 0]["level"] is None
    assert status[9, "a", 1] == "orphan_result" and got[9, "a", 1]["n_results"] == 2
    assert status[1, None, 1] == "orphan_result"


def test_levels_match_walking_up(spark):
    rng = random.Random(1)
    parent = {f"n{i}": (f"n{rng.randrange(i)}" if i and rng.random() < 0.9 else None) for i in range(300)}
    parent.update({f"m{i}": f"m{i - 1}" if i else None for i in range(500)})
    parent.update({"p": "q", "q": "r", "r": "p", "t": "p", "gone": "nowhere"})

    def level(c):
        n, seen = 0, set()
        while parent[c] in parent:
            if c in seen:
                return None
            seen.add(c)
            c, n = parent[c], n + 1
        return n

    df = spark.createDataFrame([(7, c, p) for c, p in parent.items()], "conv_id long, call_id string, parent_id string")
    got = {r["call_id"]: (r["level"], r["cyclic"]) for r in toolcalls.topological_levels(df).collect()}
    assert got == {c: (level(c), level(c) is None) for c in parent}


def test_canonical_json(spark):
    texts = ['{"b":1.50,"a":{"d":[3,1,{"y":0,"x":null}],"c":"\\u00e9"}}', "[ ]", '"x"', None, "{", '{"a":1,"a":1}']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(toolcalls.canonical_json(df["t"])).collect()]
    assert got == ['{"a":{"c":"é","d":[3,1,{"x":null,"y":0}]},"b":1.5}', "[]", '"x"', None, None, None]


def test_empty_and_long(spark, schemas):
    assert link(spark, schemas, [], []) == []
    long = json.dumps({"q": "x" * 300000})
    (row,) = link(spark, schemas, [(1, "a", 0, "f", long, None)], [(1, "a", 1, "y" * 300000)])
    assert row["status"] == "ok" and json.loads(row["record"])["arguments"] == json.loads(long)


def test_query_links_every_turn(spark):
    from flagloom.llm.queries import op2_tool_calls, read

    d = "/root/testdata/sf0.01"
    got = op2_tool_calls(spark, d).collect()
    turns = read(spark, d, "conversations").where("role = 'assistant'").collect()
    calls = {(r["conv_id"], r["seq"]): r for r in got if r["status"] != "orphan_result"}
    assert set(calls) == {(t["conv_id"], t["turn"]) for t in turns}
    text = {(t["conv_id"], t["turn"]): t["text"] for t in turns}
    for k, r in calls.items():
        args = json.loads(r["record"])["arguments"]
        if r["status"] == "ok":
            assert text[k] in args.values() and list(args) == sorted(args)
    assert {"ok", "invalid", "bad_json", "unknown_tool", "no_result", "orphan_result"} <= {r["status"] for r in got}


def test_no_python_on_the_plan(spark):
    from flagloom.llm.queries import op2_tool_calls

    plan = op2_tool_calls(spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))
