import random

import pytest
from pyspark.sql import functions as F

from textquarry.functions import text as tx

ODD = [
    "", "\n", "a", "a\nb", "a\r\nb\n", "a\rb\r\n\r\nc", "x\x0by\x0cz", "p\x1cq\x1dr\x1es", "u\x85v",
    "k l m", "tail\n\n", "\n\nhead", "café Über 中文字", "\U0001f600\U0001f601ab\U0001f602c", "  sp　ace\x1f x\xa0",
    "a\x1fb",
]


def _random_texts():
    rng = random.Random(7)
    alphabet = ["a", "b", "C", " ", " ", "\n", "é", "\U0001f600", "\t", ";", "\r\n"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 400))) for _ in range(60)]


TEXTS = ODD + _random_texts()


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")


def values(df, column):
    return [r.v for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def test_lines(texts):
    assert values(texts, tx.lines("text")) == [t.splitlines() for t in TEXTS]


def test_strip(texts):
    assert values(texts, tx.strip("text")) == [t.strip() for t in TEXTS]


def test_trigrams(texts):
    want = [{t[i : i + 3] for i in range(len(t) - 2)} for t in (x.lower() for x in TEXTS)]
    assert [set(v) for v in values(texts, tx.trigrams("text"))] == want


def test_token_counts(texts):
    assert values(texts, tx.token_count("text")) == [max(1, len(t.split())) for t in TEXTS]
    assert values(texts, tx.token_count("text", "chars4")) == [
        max(1, (len(t) + 3) // 4) for t in TEXTS
    ]
    counted = tx.token_counter(lambda ts: [len(t) for t in ts])("text")
    assert values(texts, counted) == [len(t) for t in TEXTS]
    with pytest.raises(ValueError):
        tx.token_count("text", "other")


@pytest.mark.parametrize("window,overlap", [(10, 3), (10, 0), (5, 4), (4, 9), (7, 5), (1000, 10)])
def test_windows(texts, window, overlap):
    step = max(1, window - overlap)
    want = [[t[i : i + window] for i in range(0, len(t), step)] for t in TEXTS]
    assert values(texts, tx.hard_wrap("text", window, overlap)) == want


def test_window_of_nothing_keeps_the_text(texts):
    assert values(texts, tx.hard_wrap("text", 0, 5)) == [[t] for t in TEXTS]


def plain_chunks(text, size, overlap):
    ls = text.splitlines()
    return [
        (s + 1, min(s + size, len(ls)), "\n".join(ls[s : s + size]))
        for s in range(0, len(ls), size - overlap)
    ]


@pytest.mark.parametrize("size,overlap", [(100, 10), (5, 2), (3, 0), (1, 0)])
def test_chunks(texts, size, overlap):
    got = values(texts, tx.chunks("text", size, overlap))
    assert [[tuple(c) for c in v] for v in got] == [plain_chunks(t, size, overlap) for t in TEXTS]


def test_chunks_cover_every_line(texts):
    for v, t in zip(values(texts, tx.chunks("text", 5, 2)), TEXTS):
        assert {n for c in v for n in range(c.start_line, c.end_line + 1)} == set(
            range(1, len(t.splitlines()) + 1)
        )


def test_endless_overlap_is_refused():
    with pytest.raises(ValueError):
        tx.chunks("text", 10, 10)


def plain_limits(chunks, most, target, over, chars, window, hard_over):
    out = []
    for start, end, body in chunks:
        tokens = max(1, len(body.split()))
        if body and tokens > most:
            per = max(1.0, len(body) / tokens)
            win, ovl = max(1, int(per * target)), int(per * over)
        elif len(body) > chars:
            win, ovl = window, hard_over
        else:
            out.append((start, end, body))
            continue
        for i in range(0, len(body), max(1, win - ovl)):
            piece = body[i : i + win]
            n = piece.count("\n") + 1
            out.append((start, start + n - 1, piece))
            start += n
    return out


def test_limits(texts):
    got = values(
        texts,
        tx.limit_chunks(
            tx.chunks("text", 8, 2), max_tokens=12, target_tokens=6, token_overlap=2,
            hard_chars=40, hard_window=25, hard_overlap=5,
        ),
    )
    want = [plain_limits(plain_chunks(t, 8, 2), 12, 6, 2, 40, 25, 5) for t in TEXTS]
    assert [[tuple(c) for c in v] for v in got] == want
    assert any(len(w) > len(plain_chunks(t, 8, 2)) for w, t in zip(want, TEXTS))


def test_limits_by_a_tokenizer_of_its_own(texts):
    count = tx.chunk_token_counter(lambda ts: [len(t.split()) for t in ts])
    limits = dict(max_tokens=12, target_tokens=6, token_overlap=2)
    cut = texts.select("i", tx.chunks("text", 8, 2).alias("cs"))
    counted = cut.withColumn("n", count(F.transform("cs", lambda c: c["content"])))
    got = values(counted, tx.limit_chunks(F.col("cs"), token_counts=F.col("n"), **limits))
    assert got == values(cut, tx.limit_chunks(F.col("cs"), **limits))


def test_exact_lines_follow_the_text(spark):
    body = "\n".join(f"line {i}" for i in range(200))
    df = spark.createDataFrame([(0, body)], "i int, text string")
    pieces = values(
        df,
        tx.limit_chunks(
            tx.chunks("text", 500, 0), hard_chars=100, hard_window=90, hard_overlap=30, exact_lines=True
        ),
    )[0]
    for k, p in enumerate(pieces):
        start = body[: k * 60].count("\n") + 1
        assert (p.start_line, p.end_line) == (start, start + p.content.count("\n"))


def test_long_mixed_width_text_is_cut_without_trouble(spark):
    body = "a\U0001f600" * 60_000
    df = spark.createDataFrame([(0, body)], "i int, text string")
    got = values(df, tx.hard_wrap("text", 10_000, 1_000))[0]
    assert got == [body[i : i + 10_000] for i in range(0, len(body), 9_000)]


@pytest.mark.parametrize("limit", [1, 2, 5])
def test_segments(texts, limit):
    want = [
        [t] if len(t) <= limit * 4 else [t[i : i + limit * 3] for i in range(0, len(t), limit * 3)]
        for t in TEXTS
    ]
    assert values(texts, tx.segments("text", limit)) == want


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 8, 13])
def test_truncated_reading(spark, n):
    blobs = [t.encode() for t in TEXTS] + [b"\xff\xfeab", b"ok\xe2\x82", b"\x89PNG\r\n\x1a\n\x00"]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(blobs)], "i int, raw binary")
    want = [
        b[:n].decode(errors="replace") + "\n\n[... truncated ...]" if len(b) > n else b.decode(errors="replace")
        for b in blobs
    ]
    assert values(df, tx.truncate_bytes("raw", n)) == want


def test_decode_and_hash(spark):
    import hashlib

    blobs = [b"", b"abc", b"\xc3(", "é".encode()]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(blobs)], "i int, raw binary")
    assert values(df, tx.decode_utf8("raw")) == [b.decode(errors="replace") for b in blobs]
    assert values(df, tx.content_hash("raw")) == [hashlib.sha256(b).hexdigest() for b in blobs]
    assert values(df, F.octet_length("raw")) == [len(b) for b in blobs]
