"""The classifier against a restatement of its definition on sets of byte strings."""

import random
import zlib

import numpy as np
import pytest

from textquarry.llm import language

STEMS = {"aa": "tha ing and wher ough", "bb": "ein sch ung der lich", "cc": "ció ñas que los mente", "dd": "这 是 中文 的 文本"}


def corpus(n, seed):
    r, rows = random.Random(seed), []
    for i in range(n):
        lang = r.choice(list(STEMS))
        words = ["".join(r.choice(STEMS[lang].split()) for _ in range(r.randint(1, 3))) for _ in range(r.randint(2, 25))]
        if r.random() < 0.2:  # some are mixed
            words += r.choice(list(STEMS.values())).split()
        rows.append((i * 7 + 3, r.choice([" ", "\n", ", 42 "]).join(words).upper() if i % 9 == 0 else " ".join(words), lang if i % 11 else None))
    return rows


def grams(text):
    raw = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in text.lower().encode())
    return {raw[i : i + k] for k in (1, 2, 3) for i in range(len(raw) - k + 1)}


def brute(rows, landmarks, ridge):
    """Predictions of all rows: kernel |A & B| / sqrt(|A| |B|) on the grams that landmarks have,
    ridge regression of each language against the rest on its Nyström columns."""
    learn = sorted((i, grams(t), lang) for i, t, lang in rows if lang and zlib.crc32(str(i).encode()) % 5)
    names = sorted({lang for _, _, lang in learn})
    chosen = [g for c in names for g in [g for _, g, lang in learn if lang == c][:landmarks]]
    known = set().union(*chosen)

    def kernel(a, b):
        a, b = a & known, b & known
        return len(a & b) / np.sqrt(max(len(a), 1) * max(len(b), 1))

    k = np.array([[kernel(g, m) for m in chosen] for _, g, _ in learn])
    inner = np.array([[kernel(a, b) for b in chosen] for a in chosen])
    size = {c: sum(lang == c for _, _, lang in learn) for c in names}
    weight = np.diag([1 / size[lang] for _, _, lang in learn])
    target = np.array([[float(lang == c) for c in names] for _, _, lang in learn])
    alpha = np.linalg.solve(k.T @ weight @ k + ridge * inner / len(chosen) + 1e-9 * np.eye(len(chosen)), k.T @ weight @ target)
    out = {}
    for i, t, _ in rows:
        value = np.array([kernel(grams(t), m) for m in chosen]) @ alpha
        out[i] = dict(zip(names, value))
    return out


@pytest.mark.parametrize("landmarks,ridge", [(4, 1e-2), (15, 1e-1)])
def test_same_as_the_definition(spark, landmarks, ridge):
    rows = corpus(220, landmarks)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = language.predict(docs, language.fit(docs, 10**6, landmarks, ridge)).collect()
    want = brute(rows, landmarks, ridge)
    assert len(got) == len(rows)
    for r in got:
        values = want[r.doc_id]
        assert abs(r.score - min(1, max(0, max(values.values())))) < 2e-3
        assert values[r.lang_pred] > max(values.values()) - 2e-3


def test_long_texts_are_read_whole(spark, monkeypatch):
    monkeypatch.setattr(language, "_SLAB", 64)
    for _, text, _ in corpus(12, 5):
        codes = {int(c) for part in language.gram_codes(text * 9) for c in part}
        assert len(codes) == len(grams(text * 9))
