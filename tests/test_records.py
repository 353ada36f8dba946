import json

import pytest
from pyspark.sql import functions as F

from textquarry.functions import redact
from textquarry.functions.records import canonical_record, notebook_text
from textquarry.operators import chunks

PLAIN = [
    ({"prompt": "p", "answer": "a"}, "p\n\n--SOLUTION--\n\na"),
    ({"text": "t", "task": "first"}, "first"),
    ({"task": "", "text": "second"}, "second"),
    ({"task": ["one", "two"], "sig": "f(x)", "doc": "why"}, "one\ntwo\n\nf(x)\n\nwhy"),
    ({"note": "n" * 21, "short": "s", "more": "m" * 30}, "n" * 21 + "\n\n" + "m" * 30),
    ({"content": "c", "output": ["x", "y"]}, "c\n\n--SOLUTION--\n\nx\ny"),
    ({"a": "b"}, '{"a":"b"}'),
    ({"text": "ünï", "solution": ""}, "ünï"),
    ({"note": "[x] " + "n" * 30, "more": "{" + "m" * 30}, "[x] " + "n" * 30 + "\n\n{" + "m" * 30),
    ({"text": "false"}, "false"),
    ({"task": "null", "answer": "0"}, "null\n\n--SOLUTION--\n\n0"),
    ({"text": "[1, 2]"}, "[1, 2]"),
    ({"n": 10**24, "note": "s" * 25}, "s" * 25),
    ({"task": [], "sig": {}, "doc": 0, "text": ["a", True, None, 2]}, "a\nTrue\nNone\n2"),
    ({"text": True, "answer": 1}, "True\n\n--SOLUTION--\n\n1"),
]
RAW = [("not json", "not json"), ('{"a": 1', '{"a": 1')]
EXOTIC = [
    ({"task": True, "doc": {"k": 1}}, "True\n\n{'k': 1}"),
    ({"text": 3.0, "answer": 0}, "3.0"),
    ([1, "b"], "[1, 'b']"),
]


def table(spark, lines):
    text = "\n".join(["", *lines, "   "])
    return spark.createDataFrame([(1, text)], "doc_id long, text string")


@pytest.mark.parametrize("exact", [False, True])
def test_records(spark, exact):
    cases = [(json.dumps(o, ensure_ascii=False, separators=(",", ":")), w) for o, w in PLAIN] + RAW
    got = chunks.record_table(table(spark, [c for c, _ in cases]), exact=exact).orderBy("record")
    assert [r.content for r in got.collect()] == [w for _, w in cases]


def test_exotic_values_as_python_prints_them(spark):
    got = chunks.record_table(table(spark, [json.dumps(o) for o, _ in EXOTIC]), exact=True)
    assert [r.content for r in got.orderBy("record").collect()] == [w for _, w in EXOTIC]


@pytest.mark.parametrize("exact", [False, True])
def test_solution_can_be_left_out(spark, exact):
    got = chunks.record_table(
        table(spark, ['{"prompt":"p","answer":"a"}']), include_solution=False, exact=exact
    )
    assert [r.content for r in got.collect()] == ["p"]


def test_solution_by_repo(spark):
    df = spark.createDataFrame(
        [('{"prompt":"p","answer":"a"}', True), ('{"prompt":"p","answer":"a"}', False)], "line string, keep boolean"
    )
    got = df.select(canonical_record("line", F.col("keep")).alias("v")).collect()
    assert [r.v for r in got] == ["p\n\n--SOLUTION--\n\na", "p"]


def test_jsonl_files_are_chunked_by_record(spark):
    df = spark.createDataFrame(
        [(1, "r", "d.jsonl", '{"text":"a"}\n\n{"text":"b"}\n'), (2, "r", "d.txt", "x\ny\n"), (3, "r", "e.jsonl", "")],
        "doc_id long, repo string, path string, text string",
    )
    got = chunks.embedding_chunks(df).orderBy("doc_id", "chunk_index").collect()
    assert [(r.doc_id, r.chunk_index, r.start_line, r.end_line, r.content) for r in got] == [
        (1, 0, 1, 1, "a"),
        (1, 1, 1, 1, "b"),
        (2, 0, 1, 2, "x\ny"),
    ]


def test_notebooks(spark):
    cells = [
        {"cell_type": "markdown", "source": ["# T\n", "x"]},
        {"cell_type": "code", "source": "print(1)"},
        {"cell_type": "code", "source": ["  "]},
        {"cell_type": "raw", "source": ["no"]},
        {"cell_type": "code", "source": "[1, 2]"},
    ]
    books = [json.dumps({"cells": cells, "metadata": {}}), '{"cells": []}', "{", "[]", json.dumps({"x": 1})]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(books)], "i int, text string")
    got = [r.v for r in df.select("i", notebook_text("text").alias("v")).orderBy("i").collect()]
    assert got[0].split("\n\n")[:2] == ["# T\nx", "print(1)"]
    assert got[1:] == [None, None, None, None]


def test_access_log(spark):
    headers = {"Authorization": "s", "COOKIE": "s", "Accept": "ok", "x-forwarded-for": " 1.2.3.4 , 5.6.7.8"}
    rows = [(headers, "/a?b=c?d", "9.9.9.9", "x" * 501), ({"x-forwarded-for": ""}, "/a", "9.9.9.9", "y" * 500)]
    df = spark.createDataFrame(rows, "h map<string,string>, path string, peer string, body string")
    one, two = df.select(
        redact.redact_headers("h").alias("h"),
        redact.redact_query("path").alias("path"),
        redact.client_ip("h", "peer").alias("ip"),
        redact.body_preview("body").alias("body"),
        redact.body_preview("body", F.lit(True)).alias("cut"),
    ).collect()
    assert one.h == {**headers, "Authorization": "<redacted>", "COOKIE": "<redacted>"}
    assert (one.path, one.ip, one.body) == ("/a?<redacted>", "1.2.3.4", "x" * 500 + "... [truncated]")
    assert (two.path, two.ip, two.body, two.cut) == ("/a", "9.9.9.9", "y" * 500, "y" * 500 + "... [truncated]")
