import json

from pyspark.sql import functions as F

from gradeloom.functions.replies import tool_calls

TOOLS = ["get_task_context", "submit_final_code", "validate_candidate_code"]
CODE = 'def f(x):\n    d = {"a": [1, {"b": 2}]}\n    return d["a"]'


def calls(spark, replies, tools=TOOLS):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, reply string")
    rows = df.select("i", tool_calls(F.col("reply"), tools).alias("c")).orderBy("i").collect()
    return [[(c.id, c.name, json.loads(c.arguments) if c.arguments[:1] == "{" else c.arguments) for c in r.c] for r in rows]


def test_calls_of_whole_replies(spark):
    replies = [
        '{"tool_calls": [{"name": "get_task_context", "arguments": {"window": "all"}}], "content": ""}',
        '{"final_code": "x = 1", "notes": []}',
        '{"window": "all"}',
        '{"code": "x = 1"}',
        '{"name": "validate_candidate_code", "arguments": {"code": "y"}}',
        '{"tool_calls": [{"id": "k", "function": {"name": "a", "arguments": "raw text"}}, {"name": ""}, 7, {"name": "b", "arguments": [1]}, {"name": "c"}]}',
        '{"tool_calls": null, "name": "a"}',
        '{"content": "x", "window": 1}', "plain words", None, "", "[1]", '{"window": 1, "more": 2}',
    ]
    got = calls(spark, replies)
    assert got[0] == [("local_call_1", "get_task_context", {"window": "all"})] and got[1] == []
    assert got[2] == [("local_call_1", "get_task_context", {"window": "all"})] and got[3] == [("local_call_1", "submit_final_code", {"code": "x = 1"})]
    assert got[4] == [("local_call_1", "validate_candidate_code", {"code": "y"})]
    assert got[5][0] == ("k", "a", "raw text") and [(n, a) for _, n, a in got[5][1:]] == [("b", {}), ("c", {})]
    assert got[6] == [("local_call_1", "a", {})] and got[7:] == [[]] * 6
    assert calls(spark, ['{"window": 1}', '{"code": "x"}'], ["other"]) == [[], []]


def test_code_is_recovered_from_broken_replies(spark):
    broken = lambda name, code, end: f'{{"tool_calls": [{{"name": "{name}", "arguments": {{"code": "{code}"{end}'
    ends = ["}}], \"content\": \"\"}", "}}]}", "", "}]}"]
    got = calls(spark, [broken("submit_final_code", CODE, e) for e in ends] + [broken("validate_candidate_code", 'print(\\"a\\")\\n\\tx = "y"', ends[0]), broken("other_tool", CODE, ends[0]), '{"name": "submit_final_code", "code": "a"b"}', broken("submit_final_code", "", ends[0])])
    assert got[:4] == [[("local_call_1", "submit_final_code", {"code": CODE})]] * 4
    assert got[4] == [("local_call_1", "validate_candidate_code", {"code": 'print("a")\n\tx = "y"'})] and got[5] == [] and got[6] == []
    assert got[7] == [("local_call_1", "submit_final_code", {"code": ""})]
    long = "x = \"1\"\n" * 20_000
    assert calls(spark, [broken("submit_final_code", long, ends[0])])[0][0][2] == {"code": long.strip()}
