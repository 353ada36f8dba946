import hashlib
import random
import re

import data
import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.llm import decontaminate, language, line_templates, suffixes
from textquarry.llm.suffix_array import common_prefixes, suffix_array


# --- suffix arrays ----------------------------------------------------------------------------


def test_suffix_array_and_common_prefixes():
    rnd = random.Random(1)
    for _ in range(400):
        t = np.array([rnd.randint(0, rnd.choice([1, 2, 5, 200])) for _ in range(rnd.randint(1, 50))], np.uint8)
        t = np.tile(t, rnd.choice([1, 1, 3]))
        order = suffix_array(t)
        assert order.tolist() == sorted(range(len(t)), key=lambda i: bytes(t[i:]))
        shares = common_prefixes(t, order)
        for i, j in zip(order, order[1:]):
            a, b = bytes(t[i:]), bytes(t[j:])
            want = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
            assert shares[j] == want


def brute_suffixes(rows):
    last = (1 << 63) - 1
    seen, out = {}, []
    for d, t in sorted(set(rows), key=lambda r: last if r[0] is None else r[0]):
        key = last if d is None else d
        raw, own = (t or "").encode(), set()
        covered = np.zeros(len(raw), bool)
        for s in range(len(raw) - 99):
            w = raw[s : s + 100]
            if w in own or seen.get(w, last + 1) < key:
                covered[s : s + 100] = True
            own.add(w)
        for w in own:
            seen.setdefault(w, key)
        kept = np.frombuffer(raw, np.uint8)[~covered].tobytes()
        runs = int(covered[:1].sum() + (covered[1:] & ~covered[:-1]).sum())
        row = (d, len(raw), int(covered.sum()), runs, hashlib.sha256(kept).hexdigest())
        out += [row] * rows.count((d, t))
    return sorted(out, key=str)


@pytest.mark.parametrize("group, shard", [(2048, 768 << 10), (2, 3000)])
def test_suffixes_same_as_all_windows(spark, monkeypatch, group, shard):
    monkeypatch.setattr(suffixes, "GROUP", group)
    monkeypatch.setattr(suffixes, "SHARD_BYTES", shard)
    rows = data.rows() + [(71, data.rows()[3][1] + " tail")]
    got = suffixes.deduplicated(data.frame(spark, rows)).withColumn("h", F.sha2("kept", 256)).drop("kept")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_suffixes(rows)


def test_suffixes_in_slabs(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "_PIECE", 256)
    rows = data.rows()
    got = suffixes.deduplicated(data.frame(spark, rows)).withColumn("h", F.sha2("kept", 256)).drop("kept")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_suffixes(rows)


def test_suffixes_of_nothing(spark):
    assert suffixes.deduplicated(data.frame(spark, [])).collect() == []


# --- benchmark decontamination ----------------------------------------------------------------


def bare(text):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    return re.findall(rb"[0-9a-z\x80-\xff]+", low)


def overlap(doc, item):
    n, best = len(item), 0
    window = min(n, 16)
    for shift in range(window - n, len(doc) - window + 1):
        for a in range(max(shift, 0), min(shift + n, len(doc)) - window + 1):
            best = max(best, sum(doc[a + i] == item[a + i - shift] for i in range(window)))
    return best if n >= 5 and len(doc) >= window and best >= (13 if n >= 16 else n) else 0


def test_leaks_same_as_all_alignments(spark):
    items = [(i, data.prose(900 + i, n)) for i, n in enumerate([30, 40, 16, 15, 7, 5, 4, 0])] + [(8, None), (None, data.prose(1, 20))]
    rnd, rows = random.Random(3), data.rows()
    for k in range(60):
        item = items[k % 7][1]
        rows.append((200 + k, f"{data.prose(k, 20)}. {data.edited(item, k, rnd.randint(0, 4))}, {data.prose(k + 99, 12)}"))
        rows.append((300 + k, data.prose(k, 5) + " " + " ".join(item.split()[rnd.randint(0, 9) :])))
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS hash", "2 AS at")
    got = decontaminate.leaks(data.frame(spark, rows), bench).collect()
    want = {}
    for d, t in rows:
        for i, u in items:
            if i is not None and (alike := overlap(bare(t), bare(u))):
                want[d, i] = alike
    assert {(r.doc_id, r.item_id): r.alike for r in got} == want and len(got) == len(want) > 40
    clean = decontaminate.without_leaks(data.frame(spark, rows), bench)
    assert clean.columns == data.frame(spark, []).columns
    hit = {d for d, _ in want}
    assert sorted((r.doc_id, r.text) for r in clean.where("doc_id IS NOT NULL").collect() if r.text) == sorted(
        (d, t) for d, t in rows if d is not None and t and d not in hit
    )


def test_leaks_in_passes(spark, monkeypatch):
    items = spark.createDataFrame([(i, data.prose(i, 40)) for i in range(8)], "item_id long, text string")
    docs = data.frame(spark, data.rows())
    whole = sorted(map(tuple, decontaminate.leaks(docs, items).collect()), key=str)
    monkeypatch.setattr(decontaminate, "PASS_HASHES", 100)
    assert sorted(map(tuple, decontaminate.leaks(docs, items).collect()), key=str) == whole != []


def test_leaks_of_nothing(spark):
    items = spark.createDataFrame([(1, data.prose(1, 20))], "item_id long, text string")
    docs = data.frame(spark, data.rows())
    assert decontaminate.leaks(docs.where("false"), items).collect() == []
    assert decontaminate.leaks(docs, items.where("false")).collect() == []
    assert decontaminate.without_leaks(docs, items.where("false")).count() == docs.count()


# --- line templates ---------------------------------------------------------------------------


def brute_lines(rows, shares=line_templates.SHARES, long=line_templates.LONG):
    docs = list(dict.fromkeys((d, t) for d, t in rows if t is not None))
    lines = {}
    for doc in docs:
        for line in dict.fromkeys(doc[1].split("\n")):
            raw = [x for x in re.split("[ \t\r]+", line) if x]
            if raw:
                masked = ["<*>" if re.search("[0-9]", x) else x for x in raw]
                leaf = (len(raw), *(masked if len(raw) > 3 else raw)[:3])
                lines.setdefault(line, (leaf, masked, []))[2].append(doc)
    leaves, at = {}, {}
    for leaf, tokens, own in lines.values():
        leaves.setdefault(leaf, set()).update(own)
        for i, x in enumerate(tokens):
            at[leaf, i, x] = at.get((leaf, i, x), 0) + len(own)
    templates = {}
    for line, (leaf, tokens, own) in lines.items():
        if len(leaves[leaf]) < 3:
            continue
        total = at[leaf, 0, tokens[0]]
        for share in (0, *shares):
            fixed = [i < 3 or at[leaf, i, x] >= max(3, share * total) for i, x in enumerate(tokens)]
            if sum(fixed[3:]) >= 0.5 * len(fixed[3:]):
                shape = (leaf, *(x if f else "<*>" for x, f in zip(tokens, fixed)))
                templates.setdefault(shape, {})[line] = own
    groups = [g for g in templates.values() if len({d for ds in g.values() for d in ds}) >= 3]
    groups += [{line: own} for line, (leaf, _, own) in lines.items() if leaf[0] > long and len(own) == 2]
    lost = {}
    for members in groups:
        first = min((d for ds in members.values() for d, _ in ds if d is not None), default=None)
        for line, ds in members.items():
            for doc in ds:
                if doc[0] != first:
                    lost.setdefault(doc, set()).add(line)
    return [
        (d, None if t is None else "\n".join(x for x in t.split("\n") if x not in lost.get((d, t), ()))) for d, t in rows
    ]


def line_rows(seed):
    """Documents of lines of every length in leaves of few and many values, some of them long."""
    r = random.Random(seed)
    long = [data.prose(700 + i, r.randint(49, 53)) for i in range(4)]
    out = []
    for i in range(90):
        own = [data.prose(900 + i, r.randint(1, 12))]
        for _ in range(r.randint(0, 6)):
            own.append(
                r.choice(
                    [
                        f"one {r.randint(0, 3)}", "a b c", f"job {r.choice('xyz')} done by {r.choice('pqrstu')} in {r.choice('klmnopvw')} at {r.randint(0, 9)}",
                        f"x y z {data.prose(r.randint(0, 9), 2)} w", r.choice(long), "", "  tab\tand  space ", f"{data.prose(r.randint(0, 40), 5)}",
                    ]
                )
            )
        r.shuffle(own)
        out.append((i if i % 17 else None, "\n".join(own)))
    return out + out[:3] + [(5, "other text of five\na b c")]


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_of_every_level_same_as_a_plain_tree(spark, seed):
    rows = line_rows(seed)
    got = line_templates.deduplicated_lines(data.frame(spark, rows, False), dropped="n_dropped").collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(brute_lines(rows), key=str)
    assert sum(r.n_dropped for r in got) > 100


def test_lines_same_as_a_plain_tree(spark):
    rows = data.rows() + [(None, f"{data.prose(1, 3)}\nUser 9 logged in from host none today")]
    df = data.frame(spark, rows)
    got = line_templates.deduplicated_lines(df, dropped="n_dropped")
    assert got.columns == [*df.columns, "n_dropped"]
    got = got.collect()
    want = brute_lines(rows)
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(want, key=str)
    assert sum(r.n_dropped for r in got) >= 10
    texts = {r.doc_id: r.text for r in got}
    assert "logged in" in texts[50] and all("logged in" not in texts[50 + i] for i in range(1, 6))


def test_lines_run_without_python(spark):
    plan = line_templates.deduplicated_lines(data.frame(spark, data.rows()))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|InArrow", plan)


def test_lines_of_nothing(spark):
    assert line_templates.deduplicated_lines(data.frame(spark, [])).collect() == []


# --- language ---------------------------------------------------------------------------------

STEMS = {"aa": ["tha", "ing", "and", "wher", "ough"], "bb": ["ein", "sch", "ung", "der", "lich"], "cc": ["ció", "ñas", "que", "los", "mente"]}


def labelled(n):
    r = random.Random(6)
    out = []
    for i in range(n):
        lang = r.choice(list(STEMS))
        text = " ".join("".join(r.choice(STEMS[lang]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(3, 40)))
        out.append((i, text, lang))
    return out


def test_language_of_held_out_documents(spark):
    rows = labelled(600) + [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 !?", "cc"), (None, "thaing", None), (3, "der lichung", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' AS score", "'y' AS lang_pred")
    model = language.fit(docs, per_class=100, landmarks=20)
    got = language.predict(docs, model).withColumn("out", language.held_out(F.col("doc_id"))).collect()
    assert len(got) == len(rows)
    truth = {i: lang for i, _, lang in rows if i is not None and i < 600 and lang}
    out = [r for r in got if r.out and r.doc_id in truth]
    assert len(out) > 80 and sum(r.lang_pred == truth[r.doc_id] for r in out) >= 0.97 * len(out)
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (1000, 1001, 1002)} == {"und"}
    kept = language.with_known_language(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3


def test_language_does_not_learn_from_held_out_rows(spark):
    docs = spark.createDataFrame(labelled(300), "doc_id long, text string, lang string")
    poisoned = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    a, b = language.fit(docs), language.fit(poisoned)
    assert a.languages == b.languages and (a.weights == b.weights).all()


def test_language_of_nothing(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert language.fit(docs.where("false")) is None
    assert [tuple(r) for r in language.predict(docs, language.fit(docs)).collect()] == [(1, "und", 0.0)]
