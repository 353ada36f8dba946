import hashlib

import pytest
import regex
from data import frame, rows
from pyspark.sql import functions as F

from textquarry.llm import fill_middle as fm


def numbers(key):
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def brute(key, text, unit=None):
    """(n, form, prefix units, middle units, output) by plain slicing of the list of units."""
    text = text or ""
    units = list(text) if unit is None else regex.findall(unit, text)
    h1, h2, h3, h4 = numbers(key)
    if not text or any(m in text for m in fm.MARKS) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return len(units), "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


TEXTS = rows() + [(200 + i, t) for i, t in enumerate(["<P>", "a<M>b", "<", "<S", "S><P", "x" * 5000 + "é😀́", "\r\n \x00", "é" * 40])]
TEXTS += [(300 + i, "<P<S<M><" * 3 + "ab c\n" * i) for i in range(40)]


@pytest.mark.parametrize("window", [fm.WINDOW, 7])
def test_all_cuts_and_back(spark, window):
    df = frame(spark, TEXTS).withColumn("fim_text", F.lit(1)).withColumn("fim", F.lit("mine"))
    got = fm.fill_in_middle(df, window=window)
    assert got.columns == [*df.columns, "fim_"]
    got = got.select("doc_id", "text", "fim", "fim_.*", fm.restored(F.col("fim_.output"), F.col("fim_.form")).alias("back")).collect()
    assert len(got) == len(TEXTS) and {r.fim for r in got} == {"mine"}
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r.n, r.form, r.prefix_units, r.middle_units, r.output) == brute(r.doc_id, r.text)
        assert (r.prefix_chars, r.middle_chars) == (r.prefix_units, r.middle_units)
        assert r.back == (r.text or "")


@pytest.mark.parametrize("unit,window", [(r"\X", 1 << 18), (r"\X", 9), (r"\s*\S+\s*|\s+", 1 << 18), (r"\s*\S+\s*|\s+", 50)])
def test_other_units(spark, unit, window):
    texts = [(k, t) for k, t in TEXTS if "a" * 300 not in (t or "")]
    got = fm.fill_in_middle(frame(spark, texts, False), unit=unit, window=window).select("doc_id", "text", "fim.*")
    got = got.withColumn("back", fm.restored(F.col("output"), F.col("form"))).collect()
    for r in got:
        assert (r.n, r.form, r.prefix_units, r.middle_units, r.output) == brute(r.doc_id, r.text, unit), r.text
        assert r.back == (r.text or "")
        if r.form != "plain":
            cut = r.text[: r.prefix_chars], r.text[r.prefix_chars : r.prefix_chars + r.middle_chars]
            assert [len(regex.findall(unit, c)) for c in cut][0] == r.prefix_units


def test_text_that_is_no_sequence_of_units(spark):
    with pytest.raises(Exception, match="no sequence of units"):
        fm.fill_in_middle(frame(spark, [(1, "ab1")], False), unit="[a-z]").collect()


def test_empty_table(spark):
    assert fm.fill_in_middle(frame(spark, TEXTS).where("false")).collect() == []
