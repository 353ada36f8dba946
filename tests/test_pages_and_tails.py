import io
import os
import random

import pytest

from textquarry.operators import pages
from textquarry.session import run_folder
from textquarry.sources import tail


class Counted(io.BytesIO):
    """A file that counts what is read from it."""

    taken = 0

    def read(self, n=-1):
        out = super().read(n)
        self.taken += len(out)
        return out


@pytest.mark.parametrize("block", [1, 2, 7, 1000])
def test_last_lines(block):
    texts = ["", "\n", "a", "a\n", "a\nb", "a\nb\n", "\n\n\n", "a\r\nb\r\n\r\nc", "ü€\n" * 9, "x" * 50 + "\ny\n" + "z" * 30]
    for text in texts:
        raw = text.encode()
        lines = text.split("\n")[: -1 if text.endswith("\n") or not text else None]
        for n in (1, 2, 5, 100):
            want = [x.removesuffix("\r") for x in lines[-n:]]
            assert tail.last_lines(io.BytesIO(raw), len(raw), n, block) == want, (text, n)
    broken = b"a\n\xff\xc3\n"
    assert tail.last_lines(io.BytesIO(broken), len(broken), 5, block) == ["a", "��"]


def test_what_is_read_does_not_grow_with_the_file():
    taken = []
    for n in (10_000, 1_000_000):
        raw = b"a line of a log file\n" * n
        file = Counted(raw)
        assert tail.last_lines(file, len(raw), 200) == ["a line of a log file"] * 200
        taken.append(file.taken)
    assert taken[0] == taken[1] <= 2 * tail.BLOCK


def test_tails_of_files(spark, tmp_path):
    rnd = random.Random(1)
    logs = {f"l{i}.log": [f"{i}:{j} " + "é" * rnd.randint(0, 30) for j in range(rnd.choice([0, 1, 3, 500]))] for i in range(7)}
    for name, lines in logs.items():
        (tmp_path / name).write_text("".join(x + "\n" for x in lines))
    got = {}
    for r in tail.tail_files(spark, str(tmp_path), 20, block=64).collect():
        got.setdefault(os.path.basename(r.file), {})[r.back] = r.text
    assert got == {k: {len(v[-20:]) - i: x for i, x in enumerate(v[-20:])} for k, v in logs.items() if v}
    every = [x for _, v in sorted(logs.items()) for x in v]
    end = tail.log_end(tail.tail_files(spark, str(tmp_path), 30), 30)
    assert [r.text for r in end.collect()] == every[-30:]


def test_pages_cover_the_order(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "b", None, "c"]), rnd.randint(0, 400), i % 3) for i in range(903)] + [("b", 7, 1)] * 40
    df = spark.createDataFrame(rows, "repo string, path int, extra int").repartition(5)
    index = pages.build_pages(df, ["repo", "path"], run_folder(spark, "pages"), range_rows=100)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2]))
    assert index.total() == len(rows) and index.ranges().count() > 4
    for per_page in (1, 20, 250, 2000):
        n_pages = -(-len(rows) // per_page)
        for page in {1, 2, n_pages // 2 + 1, n_pages, n_pages + 1}:
            got = [tuple(r) for r in index.page(page, per_page).collect()]
            assert sorted(got, key=str) == sorted(want[(page - 1) * per_page : page * per_page], key=str), (page, per_page)
    late = index.page(40, 20)
    plan = late._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "TakeOrdered" not in plan and len(late.inputFiles()) <= 2
    with pytest.raises(ValueError):
        index.page(0)


def test_pages_of_nothing(spark):
    df = spark.createDataFrame([], "repo string, path int")
    index = pages.build_pages(df, ["repo"], run_folder(spark, "pages"))
    assert index.total() == 0 and index.page(1).collect() == [] and index.page(1).columns == ["repo", "path"]
