"""Small documents with everything that can go wrong, and plain restatements of the operators."""

import random
import re

from pyspark.sql import functions as F

CLASHING = "hash key node place spans lines leaf n start text_hash rank lost_id leak_id gone kept".split()
_RND = random.Random(11)
_VOCABULARY = ["".join(_RND.choice("abcdefghiklmnoprstu") for _ in range(_RND.randint(2, 8))) for _ in range(400)]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(_VOCABULARY) for _ in range(n))


def edited(text, seed, changes):
    r, words = random.Random(seed), text.split()
    for _ in range(changes):
        words[r.randrange(len(words))] = r.choice(_VOCABULARY)
    return " ".join(words)


def rows():
    """(doc_id, text): prose, exact and near copies, shared passages and lines, odd texts."""
    passage = prose(500, 60)
    out = [(i, prose(i, 40 + 7 * i)) for i in range(12)]
    out += [(20 + i, out[3][1]) for i in range(4)]
    out += [(30 + i, edited(out[9][1], i, 2)) for i in range(6)]
    out += [(40 + i, prose(40 + i, 30) + "\n" + passage + "\n" + prose(60 + i, 25)) for i in range(5)]
    out += [(50 + i, f"{prose(80 + i, 20)}\nUser {i} logged in from host {prose(90 + i, 1)} today\n{prose(70 + i, 9)}") for i in range(6)]
    out += [(60, None), (61, ""), (62, " \n\t\n "), (63, "one two"), (64, "Onе Ünï ß 字 😀 " * 30), (65, "a" * 700), (66, "ab " * 400)]
    out += [(67, prose(7, 6000)), (None, prose(3, 50)), (None, None), (None, out[3][1])]
    out += [(5, out[5][1]), (5, out[5][1]), (68, "!!! 123 ###"), (69, "x\x00y\x1cz\u00a0w  v\r\nu")]
    return out


def frame(spark, rows, clashing=True):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    df = df.withColumn("lang", F.lit("en")).withColumn("source", F.lit(None).cast("string"))
    return df.withColumns({c: F.lit("other") for c in CLASHING}) if clashing else df


def words(text):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    return re.findall(rb"[^\x20\x09-\x0d]+", low)


def shingles(text):
    w = words(text)
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
