"""Overlaps that the query and the pipeline look for beyond the defaults of ``leaks``."""

from itertools import combinations

import data

from textquarry.llm import decontaminate


def test_edited_short_items(spark):
    items = [(n, data.prose(900 + n, n)) for n in range(5, 16)]
    rows = []
    for n, text in items:
        allowed = n - -(-13 * n // 16)
        for changes in (allowed, allowed + 1):
            for at in combinations(range(n), changes):
                words = [f"new{i}" if i in at else w for i, w in enumerate(text.split())]
                rows.append((n * 10000 + len(rows), f"{data.prose(1, 20)} {' '.join(words)} {data.prose(2, 20)}", n, changes <= allowed))
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, want boolean").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench, edited=True).collect()}
    assert got == {(d, n) for d, _, n, want in rows if want}


def padded(doc, item):
    """Equal words of the best window of an item over a document with room at both ends."""
    n = len(item)
    window = min(n, 16)
    doc = [None] * n + doc + [None] * n
    same = [[doc[s + i] == item[i] for i in range(n)] for s in range(len(doc) - n + 1)]
    best = max(sum(e[a : a + window]) for e in same for a in range(n - window + 1))
    return best if best >= -(-13 * window // 16) else 0


def test_items_cut_by_an_end_of_a_document(spark):
    items = [(n, data.prose(900 + n, n)) for n in (40, 20, 16, 15, 14, 11, 7, 6)]
    texts = []
    for n, text in items:
        words = text.split()
        for kept in range(max(min(n, 16) - 5, 1), min(n, 17) + 1):
            for part in (words[:kept], words[n - kept :], words[(n - kept) // 2 :][:kept]):
                for changes in (0, 1, 2):
                    own = data.edited(" ".join(part), kept, changes)
                    texts += [f"{own} {data.prose(3, 60)}", f"{data.prose(4, 60)} {own}", own, f"{data.prose(4, 20)} {own} {data.prose(3, 20)}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.alike for r in decontaminate.leaks(docs, bench, edited=True, cut=True).collect()}
    want = {(d, n): a for d, t in enumerate(texts) for n, i in items if (a := padded(t.split(), i.split()))}
    assert got == want
    inside = decontaminate.leaks(docs, bench, edited=True).count()
    assert len(got) > inside > 0
