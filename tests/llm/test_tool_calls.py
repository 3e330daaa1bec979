import json

import pytest
from pyspark.sql import functions as F

from depweave.llm import tool_calls as C
from tests.compare import held

CALLS = "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>"
RESULTS = "conv_id long, call_id string, turn long, content string"
SCHEMAS = {
    "get": {"url": {"type": "string", "required": True, "min_length": 3, "max_length": 9}, "n": {"type": "integer", "minimum": 1, "maximum": 5}, "how": {"enum": ["a", "b"]}, "x": {"type": "number"}, "o": {"type": "object"}, "l": {"type": "array"}, "b": {"type": "boolean"}},
    "none": {},
}


def run(spark, calls, results=()):
    out = C.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(list(results), RESULTS), SCHEMAS).collect()
    return {(r.conv_id, r.call_id): r for r in out}


def call(i, args="{}", name="none", deps=None, turn=None, conv=1):
    return (conv, i, turn if turn is not None else 0, name, args, deps)


@pytest.mark.parametrize(
    "args,errors",
    [
        ('{"url":"abcd","n":3,"how":"b","x":1.5,"o":{},"l":[],"b":true}', ""),
        ('{"x":2,"url":"abc"}', ""),
        ('{"n":3}', "url: missing"),
        ('{"url":null}', "url: missing"),
        ('{"url":5,"b":"true"}', "b: not boolean;url: not string;url: too short"),
        ('{"url":"ab","n":9,"how":"c"}', "how: not listed;n: too large;url: too short"),
        ('{"url":"' + "é" * 10 + '","n":0.5,"o":[],"l":{}}', "l: not array;n: not integer;n: too small;o: not object;url: too long"),
        ("[1]", "arguments: no JSON object"),
        ("{", "arguments: no JSON object"),
        (None, "arguments: no JSON object"),
        ("", "arguments: no JSON object"),
    ],
)
def test_validation(spark, args, errors):
    r = run(spark, [call("c", args, "get")])[1, "c"]
    assert r.errors == errors and r.valid == (not errors) and r.status == "missing"
    assert json.loads(r.json)["valid"] == r.valid


def test_links_and_canonical_json(spark):
    calls = [call("c", '{ "b": 1, "a": {"z": [1, 2.5, null], "y": "q\\n\\"é"} }', turn=2), call("c", "{}", turn=7), call("lonely", turn=1), call(None, turn=3), call("c", conv=2)]
    results = [(1, "c", 5, "late"), (1, "c", 4, 'tab\t"ü'), (1, "ghost", 1, None), (2, None, 9, "stray")]
    got = run(spark, calls, results)
    assert len(got) == 6
    r = got[1, "c"]
    assert (r.status, r.n_results, r.turn) == ("linked", 2, 2)
    assert r.json == '{"call":{"arguments":{"a":{"y":"q\\n\\"é","z":[1,2.5,null]},"b":1},"id":"c","name":"none"},"result":{"content":"tab\\t\\"ü","id":"c"},"valid":true}'
    assert {k: v.status for k, v in got.items()} == {(1, "c"): "linked", (1, "lonely"): "missing", (1, None): "unidentified", (2, "c"): "missing", (1, "ghost"): "orphan", (2, None): "unidentified"}
    assert json.loads(got[1, "ghost"].json) == {"call": None, "result": {"content": None, "id": "ghost"}, "valid": False}


def test_topological_order(spark):
    calls = [call("a", turn=1), call("b", deps=["a"], turn=2), call("late", deps=["z"], turn=3), call("z", deps=["y"], turn=9), call("y", turn=9), call("after", deps=["late", "b"], turn=4), call("x", deps=["gone", None], turn=5)]
    calls += [call("p", deps=["q"], conv=2), call("q", deps=["p"], conv=2), call("r", deps=["q"], conv=2, turn=5), call("s", conv=2), call("self", deps=["self"], conv=3)]
    got = run(spark, calls)
    order = {k: (v.order_turn, v.order_hop) for k, v in got.items()}
    for conv, i, _, _, _, deps in calls:
        for d in deps or []:
            if (conv, d) in order and conv == 1:
                assert order[conv, d] < order[conv, i]
    assert order[1, "a"] == (1, 0) and order[1, "late"][0] == 9 and got[1, "x"].errors == "dependency: unknown"
    assert all(order[k] == (None, None) and "cycle" in got[k].errors for k in [(2, "p"), (2, "q"), (2, "r"), (3, "self")]) and order[2, "s"] == (0, 0)


def test_cycles_take_no_rounds_of_their_own(spark, monkeypatch):
    """A cycle of 200 calls, a call behind it, one whose dependency is null in a cycle, and calls before it."""
    rounds = []
    write = C.materialise
    monkeypatch.setattr(C, "materialise", lambda df, name: (rounds.append(name), write(df, name))[1])
    calls = [call(f"c{i}", deps=[f"c{(i + 1) % 200}", None, "start"], turn=i) for i in range(200)] + [call("start", turn=300), call("behind", deps=["c7"], turn=400), call("end", deps=["start"], turn=1)]
    got = run(spark, calls)
    assert rounds.count("ready-calls") <= 4
    assert all(("cycle" in got[1, c[1]].errors) == (c[1] not in ("start", "end")) for c in calls)
    assert (got[1, "end"].order_turn, got[1, "end"].order_hop) == (300, 1)


def test_chains_and_trees_take_few_rounds(spark, monkeypatch):
    """A chain of 300 calls that looks forward, a tree over it, calls of several dependencies and a cycle of three, against a plain loop."""
    rounds = []
    write = C.materialise

    def counted(df, name):
        rounds.append(name)
        assert rounds.count("ready-calls") <= 20
        return write(df, name)

    monkeypatch.setattr(C, "materialise", counted)
    calls = [call(f"c{i}", deps=[f"c{i + 1}"] if i < 299 else None, turn=i) for i in range(300)]
    calls += [call(f"t{i}", deps=[f"t{(i - 1) // 3}" if i else "c4"], turn=i % 7) for i in range(60)]
    calls += [call(f"m{i}", deps=[f"m{i - 1}", f"m{i - 2}", f"c{9 * i}"] if i > 1 else ["t50"], turn=500 - 50 * i) for i in range(5)]
    calls += [call(f"o{i}", deps=[f"o{(i + 1) % 3}"], turn=i) for i in range(3)] + [call("p", deps=["o1", "c8"], turn=3)]
    got = run(spark, calls)
    of, place = {c[1]: c for c in calls}, {}

    def at(i):
        if i not in place:
            place[i] = max([(of[i][2], 0), *((t, h + 1) for t, h in map(at, of[i][5] or []))])
        return place[i]

    for i in of:
        r = got[1, i]
        assert (r.order_turn, r.order_hop) == ((None, None) if i[0] in "op" else at(i)), i
        assert ("cycle" in r.errors) == (i[0] in "op")


def test_forward_references_and_cycles_against_sql(spark, tmp_path):
    rows = [(c, t, ["system", "user", "assistant", "user"][(t + c) % 4], f"{c}.{t}") for c in range(12) for t in range(3 * c) if (t * c) % 7 != 6]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert held(spark, str(tmp_path), C.query, C.SQL) > 100
    got = C.query(spark, str(tmp_path)).collect()
    assert max(r.order_hop or 0 for r in got) > 0 and any("cycle" in r.errors for r in got)


def test_extra_columns_and_long_contents(spark):
    calls = spark.createDataFrame([call("c", '{"a":"' + "x" * 300_000 + '"}')], CALLS)
    results = spark.createDataFrame([(1, "c", 5, "y" * 300_000)], RESULTS)
    odd = {n: F.lit(n) for n in ("__call", "__r", "__turn", "lost", "n_results", "order_turn", "__errors")}
    r = C.link(calls.withColumns(odd), results.withColumns(odd), SCHEMAS).first()
    assert r.status == "linked" and r.valid and len(r.json) > 600_000


def test_query_against_sql_and_empty_table(spark, tmp_path):
    rows = [(1, 0, "system", "s"), (1, 1, "user", 'q "x"\t'), (1, 2, "assistant", None), (1, 3, "user", None), (2, 0, "assistant", "a"), (2, 1, "user", "x" * 1001), (2, 3, "user", ""), (3, 0, None, "t")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert held(spark, str(tmp_path), C.query, C.SQL) == 7
    got = [r for r in C.query(spark, str(tmp_path)).collect() if r.status == "other"]
    assert sorted(r.json for r in got) == ['{"message":{"content":"s","role":"system"},"valid":true}', '{"message":{"content":"t","role":null},"valid":true}']
    assert C.link(spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS)).count() == 0


def test_repeated_turns_keep_every_text(spark, tmp_path):
    rows = [(1, 1, "user", "first"), (1, 1, "user", "second"), (1, 2, "assistant", "one"), (1, 2, "assistant", "two"), (1, 2, "assistant", "two"), (1, 3, "user", "a"), (1, 3, "user", "b"), (2, 2, "assistant", "x"), (2, 2, "assistant", "y")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert held(spark, str(tmp_path), C.query, C.SQL) == 2 * 3 + 2 + 2
    text = " ".join(r.json for r in C.query(spark, str(tmp_path)).collect())
    assert all(f'"{x[3]}"' in text for x in rows)


def test_no_python_runs(spark):
    plan = C.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
