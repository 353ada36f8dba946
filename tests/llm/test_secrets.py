import re
import uuid

import pytest
from data import CLASHING, prose, rows
from pyspark.sql import functions as F

from textquarry.llm import secrets
from textquarry.session import shared_folder

KEY = "AKIA" + "Q7" * 8
TEXTS = rows() + [
    (100, f"Ünï 😀 password = 'hunter22x' and {KEY} token:abc API-KEY=abcdef apikey=\"zzzzzz99\" {'0a' * 14}!"),
    (101, "password=token:abcdefgh secret = token=abcdef api_key:  'sk/x+y=z.1-2'"),
    (102, "AKIA AKIA1 AKIAAKIA" + "0" * 15 + " AKIA" + "B" * 15 + " xAKIA" + "C" * 16 + "d"),
    (103, "0123456789abcdef0123456 " + "f" * 24 + "G" + "0" * 23 + "A" + "e" * 60),
    (104, "-----BEGIN RSA PRIVATE KEY-----\n-----BEGIN PRIVATE KEY----- -----BEGIN A B C D E PRIVATE KEY-----"),
    (105, "ghp_" + "x" * 36 + " xoxb-1234567890-a sk_live_" + "a" * 16 + " ghx_" + "x" * 36),
    (106, "passwd:abcdef" * 400 + "paſſword=abcdefg toKen=abcdefg PassWd : : abcdefg"),
    (107, "secret:" + "a" * 100_000),
    (None, f"token={KEY}"), (100, None),
]
TEXTS += [(500 + i, TEXTS[-9][1]) for i in range(60)]


def brute(text, rules=secrets.RULES):
    out = []
    for place, r in enumerate(rules):
        for m in re.finditer(r.pattern, text or ""):
            if m.end(r.group) - m.start(r.group) >= r.least:
                out.append((m.start(), place, r.kind, r.version, m.end()))
    return [(k, v, a, b) for a, _, k, v, b in sorted(out)]


def table(spark, texts):
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    return df.withColumns({c: F.lit("other") for c in [*CLASHING, "blob_sha", "found", "todo", "m0", "other"]})


@pytest.fixture
def ledger(spark):
    return shared_folder(spark, f"test-ledger-{uuid.uuid4().hex[:8]}")


def listed(df):
    return sorted(((r.doc_id is None, r.doc_id, [tuple(x) for x in r.found]) for r in df.collect()), key=str)


def test_patterns_are_those_of_the_contract():
    name = r"(password|passwd|secret|token|api_?key)"
    plain = re.compile(name + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
    for _, text in TEXTS:
        text = text or ""
        want = [m.span() for m in plain.finditer(text) if len(m.group(2)) >= 6]
        want = [("assign", *s) for s in want]
        want += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
        want += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
        assert sorted(want) == sorted((k, a, b) for k, _, a, b in brute(text, secrets.BASE))


def test_every_span(spark, ledger):
    got = listed(secrets.find_secrets(table(spark, TEXTS), ledger, ["doc_id"]))
    assert got == sorted(((k is None, k, brute(t)) for k, t in TEXTS), key=str)
    assert {kind for _, _, found in got for kind, *_ in found} == {r.kind for r in secrets.RULES}


def test_only_unseen_pairs_are_scanned(spark, ledger):
    old = secrets.Rule("hex", 0, "[0-9a-f]{30,}")
    first = (secrets.BASE[0], old)

    def run(texts, rules):
        before = secrets.ledger_rows(spark, ledger).count()
        got = listed(secrets.find_secrets(table(spark, texts), ledger, ["doc_id"], rules=rules))
        assert got == sorted(((k is None, k, brute(t, rules)) for k, t in texts), key=str)
        log = secrets.ledger_rows(spark, ledger)
        added = log.select("blob_sha", F.explode("scanned").alias("s")).select("blob_sha", "s.kind", "s.version").distinct()
        return added.count(), log.count() - before

    distinct = len({t or "" for _, t in TEXTS})
    assert run(TEXTS[:40], first)[0] == 2 * len({t or "" for _, t in TEXTS[:40]})
    assert run(TEXTS, first)[0] == 2 * distinct
    assert run(TEXTS, first) == (2 * distinct, 0)
    assert run([(9000 + i, t) for i, (_, t) in enumerate(TEXTS)], first) == (2 * distinct, 0)
    # A new version of one rule and a new rule: only these are scanned, for every content.
    assert run(TEXTS, secrets.BASE)[0] == 4 * distinct
    assert run([*TEXTS, (9999, "secret = brand-new-1")], secrets.BASE) == (4 * distinct + 3, 1)
    assert run(TEXTS, first) == (4 * distinct + 3, 0)


def test_history_by_path_and_version(spark, ledger):
    leak, clean = "token = abcdefgh", prose(4, 30)
    history = [("a.py", 1, leak), ("a.py", 2, clean), ("b.py", 2, leak), ("b.py", 2, leak), ("c.py", None, None), ("a.py", 3, leak)]
    df = spark.createDataFrame(history, "path string, version int, body string")
    got = secrets.find_secrets(df, ledger, ["path", "version"], "body").collect()
    assert sorted((r.path, r.version or 0, len(r.found)) for r in got) == sorted((p, v or 0, int(t == leak)) for p, v, t in history)
    assert secrets.ledger_rows(spark, ledger).select("blob_sha").distinct().count() == 3


def test_empty_table_and_no_python(spark, ledger):
    df = table(spark, TEXTS)
    assert secrets.find_secrets(df.where("false"), ledger, ["doc_id"]).collect() == []
    found = secrets.find_secrets(df, ledger, ["doc_id"])
    scan = secrets._scanned(df.selectExpr("'x' AS blob_sha", "text", "array('hex@1') AS todo"), secrets.RULES)
    for plan in (found, scan):
        text = plan._jdf.queryExecution().toString()
        assert "Python" not in text and "Arrow" not in text and "Pandas" not in text


def test_running_sums(spark):
    df = spark.sql("SELECT n, transform(sequence(1, n), x -> int(x * 7 % 11)) AS a FROM range(1, 70) t(n)".replace("sequence(1, n)", "sequence(1, int(n))"))
    for r in df.select("a", secrets.running_sums(F.col("a")).alias("s")).collect():
        assert r.s == [sum(r.a[: i + 1]) for i in range(len(r.a))]
