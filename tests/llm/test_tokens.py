import random
import zlib

import data
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from textquarry.llm import packing, simple8b, token_counts, token_files, tokens

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def ids_of(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encoder_gives_the_library_ids(path, monkeypatch):
    monkeypatch.setattr(tokens, "_SLAB", 100)
    enc, lib, rnd = tokens.Encoder(path), Tokenizer.from_file(path), random.Random(1)
    odd = ["a  b   c", "  x", "x  ", "\n\n y \n", "don't stop's  ''s", "a\xa0b", "É<|endoftext|>x", "é ́x", "ﬁ ǅ", "١٢ ²½", "a'S 'LL"]
    odd += ["".join(rnd.choice(" \n\tabAB1'!é$<|,_") for _ in range(rnd.randint(1, 300))) for _ in range(400)]
    for text in odd + [t for _, t in data.rows()]:
        want = lib.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == want, repr(text)


@pytest.mark.parametrize("group", [1, 300, 1 << 22])
def test_encoder_gives_the_library_ids_by_groups(group, monkeypatch):
    monkeypatch.setattr(tokens, "_GROUP", group)
    enc, lib, rnd = tokens.Encoder(WORD, kept=50), Tokenizer.from_file(WORD), random.Random(2)
    texts = [None, "", " ", "  x", "x  ", "a\xa0b", "É<|endoftext|>x", "a\x1cb", "a\u2028b", "Don't  STOP.", "Été\tété"]
    texts += ["".join(rnd.choice(" \n\t\r\x0b\x0cabAB1'!é$<|,_ж") for _ in range(rnd.randint(0, 90))) for _ in range(200)]
    got = [np.frombuffer(ids, "<u4").tolist() for ids in enc.encode_all(iter(texts))]
    assert got == [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert not enc.pieces or group == 1  # words are not kept, only their parts
    assert len(enc.parts) <= 50 and list(enc.encode_all([])) == []


def test_caches_are_bounded():
    cache = tokens.Cache(len, kept=10)
    for i in range(1000):
        assert cache[str(i)] == len(str(i))
        assert len(cache) <= 10 and len(cache.old) <= 10
    assert cache["x" * 100] == 100 and "x" * 100 not in cache


@pytest.mark.parametrize("values", [[], [0], [1 << 59, 1, 0, 1 << 40, 7], [0] * 5000, list(range(3000))])
def test_simple8b_round_trip(values):
    ids = np.array(values, np.uint64)
    words, blocks = simple8b.encode(ids)
    assert simple8b.decode(words, blocks, len(ids)).tolist() == values
    assert blocks.sum() == len(words) and len(blocks) == -(-len(ids) // simple8b.BLOCK)


def test_simple8b_round_trip_at_random():
    rng = np.random.default_rng(3)
    for _ in range(60):
        ids = rng.integers(0, 1 << int(rng.integers(1, 33)), int(rng.integers(1, 4000)))
        assert simple8b.decode(*simple8b.encode(ids), len(ids)).tolist() == ids.tolist()


def test_token_files(spark, tmp_path):
    rows, folder = data.rows(), str(tmp_path / "tokens")
    manifest = token_files.write_token_files(data.frame(spark, rows), folder, WORD, shard_ids=3000)
    assert manifest.count() > 3
    got = sorted(token_files.read_token_files(spark, folder, manifest).collect(), key=lambda r: r.start)
    at = 0
    for (doc_id, text), r in zip(sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")), got, strict=True):
        want = ids_of(WORD, text) + [2]
        assert (r.doc_id, r.start, r.n_tokens) == (doc_id, at, len(want))
        assert np.frombuffer(r.ids, "<u4").tolist() == want
        at += len(want)


def test_token_files_of_nothing(spark, tmp_path):
    folder = str(tmp_path / "none")
    manifest = token_files.write_token_files(data.frame(spark, []), folder, WORD)
    assert token_files.read_token_files(spark, folder, manifest).collect() == []


@pytest.mark.parametrize("frequent", [1, 200])
def test_token_counts(spark, frequent):
    rows = data.rows() + [(70, "x<|endoftext|>y " + data.prose(1, 2500))]
    got = token_counts.token_counts(data.frame(spark, rows), WORD, frequent=frequent).collect()
    want = [(d, len((t or "").encode()), len(ids_of(WORD, t))) for d, t in rows]
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=str) == sorted(want, key=str)
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)
    assert token_counts.token_counts(data.frame(spark, []), WORD).collect() == []


def test_token_counts_by_sentencepiece(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    got = token_counts.token_counts(data.frame(spark, data.rows()), path).collect()
    want = [(d, len(lib.encode(t or "", num_threads=1))) for d, t in data.rows()]
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=str) == sorted(want, key=str)


def check_packing(got, rows, capacity):
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for taken in places.values():
        at = 0
        for offset, length in sorted(taken):
            assert offset == at
            at += length
        assert at <= capacity
    pieces = sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str)
    want = []
    for doc_id, text in rows:
        ids = ids_of(BYTE, text) + [2]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert pieces == sorted(want, key=str)
    return len(places)


@pytest.mark.parametrize("capacity", [64, 1024])
def test_packing(spark, capacity):
    rows = data.rows() + [(100 + i, data.prose(i, 3 + i % 90)) for i in range(300)]
    got = packing.packed_documents(data.frame(spark, rows), BYTE, capacity, group=64).collect()
    used = check_packing(got, rows, capacity)
    lengths, counts = np.unique([r.length for r in got], return_counts=True)
    least = packing.bin_bound(lengths, counts, capacity)
    assert least <= used <= 1.02 * least + 3


def test_packing_nothing(spark):
    assert packing.packed_documents(data.frame(spark, []), BYTE).collect() == []


def test_bounds_hold_and_best_fit_is_a_packing():
    rnd = random.Random(2)

    def fewest(lengths, capacity):
        best = len(lengths)

        def place(i, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if i == len(lengths):
                best = len(bins)
                return
            for b in range(len(bins)):
                if bins[b] + lengths[i] <= capacity:
                    place(i + 1, bins[:b] + [bins[b] + lengths[i]] + bins[b + 1 :])
            place(i + 1, bins + [lengths[i]])

        place(0, [])
        return best

    for _ in range(150):
        capacity = rnd.choice([10, 16, 30])
        lengths = sorted((rnd.randint(1, capacity) for _ in range(rnd.randint(1, 7))), reverse=True)
        bins, offsets, left = packing.best_fit_decreasing(lengths, capacity)
        ends = {}
        for b, o, n in zip(bins, offsets, lengths):
            assert ends.get(b, 0) == o and o + n <= capacity
            ends[b] = o + n
        assert [capacity - ends[b] for b in range(len(left))] == left
        values, counts = np.unique(lengths, return_counts=True)
        assert packing.bin_bound(values, counts, capacity) <= fewest(lengths, capacity) <= len(left)
