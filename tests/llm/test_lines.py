"""Lines that ``op2_line_templates`` and the pipeline drop, by example."""

import data

from textquarry.llm import line_templates


def left(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {r.doc_id: r.text for r in line_templates.deduplicated_lines(docs, **more).collect()}


def test_short_lines_recur_by_their_own_tokens(spark):
    short = ["Les.", "Share this", "All rights reserved.", "版权所有。保留一切权利。", "a　b c　d"]
    rows = [(i, "\n".join([data.prose(i, 9), *short, f"Page {i}", str(i), "", "twice" if i < 2 else f"own{i}"])) for i in range(4)]
    got = left(spark, rows)
    assert got[0] == rows[0][1]
    for i in range(1, 4):
        assert got[i] == "\n".join([data.prose(i, 9), f"Page {i}", str(i), "", "twice" if i < 2 else f"own{i}"])


def test_fields_of_few_values_stay_fields_as_a_table_grows(spark):
    value = lambda k, n: ["".join(chr(97 + int(c)) for c in str(1000 + i)) for i in range(n)][k % n]
    for n in (25, 1000):
        line = [f"Order shipped today to {value(i // 25, 40)} from our main warehouse by {value(i, 25)}" for i in range(n)]
        rows = [(i, f"{x}\n{data.prose(i, 7)}") for i, x in enumerate(line)]
        got = left(spark, rows)
        assert got[0] == rows[0][1]
        assert all(got[i] == data.prose(i, 7) for i in range(1, n))
    # A line that recurs as it is, in a leaf where no share reaches it, is still dropped.
    rows = [(i, f"Order shipped today {data.prose(i, 6)}") for i in range(60)]
    rows += [(100 + i, "Order shipped today with six words all of own") for i in range(3)]
    got = left(spark, rows)
    assert {i for i, t in got.items() if not t} == {101, 102}


def test_long_exact_lines_recur_from_two_documents_on(spark):
    long, short = data.prose(500, 51), data.prose(501, 50)
    rows = [(i, "\n".join([data.prose(i, 60), long if i < 2 else data.prose(70, 51) + f" {i}", short, "x"][: 4 if i < 2 else 2])) for i in range(3)]
    rows += [(9, rows[0][1].split("\n")[0] + " more")]
    got = left(spark, rows)
    assert got == dict(rows) | {1: "\n".join([data.prose(1, 60), short, "x"])}
    assert left(spark, rows, long=None) == dict(rows)
