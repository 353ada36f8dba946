import itertools

import data
import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.llm import near_dups
from textquarry.llm.components import connected_components
from textquarry.llm.words import shingle_sets, word_hashes
from textquarry.llm.worker import text_buffers


def brute(rows):
    sets = [(d, data.shingles(t)) for d, t in rows]
    root = {d: d for d, _ in sets if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x), (b, y) in itertools.combinations([s for s in sets if s[0] is not None and s[1]], 2):
        if a == b or 100 * len(x & y) >= 75 * len(x | y):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return sorted(((d, len(s), None if d is None else find(d)) for d, s in sets), key=str)


def test_same_as_all_pairs(spark):
    rows = data.rows()
    got = near_dups.near_duplicates(data.frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_copies_without_a_common_centre(spark):
    """A chain of edits: ends are unlike, and no bucket's smallest member is like all others."""
    rows, text = [], data.prose(1, 200)
    for i in range(30):
        rows.append(((i * 7) % 31, text))
        text = data.edited(text, i, 6)
    got = near_dups.near_duplicates(data.frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)


def test_blocks_of_open_clusters(spark, monkeypatch):
    """Many copies of one text with more edits than a link bears, and links only among some."""
    monkeypatch.setattr(near_dups, "COMPARED", 7)
    monkeypatch.setattr(near_dups, "_COLUMNS", 64)
    text = data.prose(77, 150)
    rows = [(i, data.edited(text, i % 40, 4 + i % 7) + (" tail" if i >= 40 else "")) for i in range(60)]
    got = near_dups.near_duplicates(data.frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)


def test_one_document_of_each_group_stays(spark):
    df = data.frame(spark, data.rows())
    kept = near_dups.without_near_duplicates(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 3 in ids and not {20, 21, 22, 23} & set(ids) and ids.count(None) == 3 and ids.count(5) == 3


def test_empty_table(spark):
    assert near_dups.near_duplicates(data.frame(spark, [])).collect() == []


def test_tables_seldom_miss_a_pair_at_the_bound():
    rng, missed = np.random.default_rng(5), 0
    for _ in range(400):
        s = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
        a, b = near_dups.half_keys(s[:350]), near_dups.half_keys(np.concatenate([s[:300], s[350:]]))
        missed += int((a == b).sum() < 2)
    assert missed <= 1


def test_word_hashes_by_slab(monkeypatch):
    import pyarrow as pa

    from textquarry.llm import words

    data_, offsets = text_buffers(pa.array([t for _, t in data.rows()]))
    whole = word_hashes(data_, offsets)
    monkeypatch.setattr(words, "_SLAB", 50)
    parts = word_hashes(data_, offsets)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
    assert np.diff(whole[1]).tolist() == [len(data.words(t)) for _, t in data.rows()]
    assert [len(s) for s in shingle_sets(*whole)] == [len(data.shingles(t)) for _, t in data.rows()]


@pytest.mark.parametrize("links", [[], [(1, 2), (2, 3), (9, 8), (8, 9)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)]])
def test_connected_components(spark, links):
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    want = {x: x for pair in links for x in pair}
    for _ in want:
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    assert got == want
