import data
import public_tokenizers
from test_texts import brute_lines
from test_tokens import check_packing

import corpus_pipeline
from textquarry.operators.sizing import staged


def test_stages(spark, tmp_path):
    """Every stage on what the one before it kept, against plain restatements."""
    rows = data.rows() + [(90, data.prose(700, 30)), (91, data.prose(5, 10) + " " + data.prose(701, 40))]
    docs = data.frame(spark, rows, clashing=False).selectExpr("*", "length(text) AS n_chars").where("doc_id IS NOT NULL")
    spark.createDataFrame([(1, data.prose(701, 40))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = staged(stage(spark, docs, str(tmp_path)), name)
        out[name] = docs
        if name != "packing":
            assert docs.columns == before.columns
    read = lambda name: sorted((r.doc_id, r.text) for r in out[name].collect())
    known = sorted((d, t) for d, t in rows if d is not None and any(c.isalpha() for c in t or ""))
    assert read("language") == known
    assert read("lines") == sorted(brute_lines(known))
    assert {r.doc_id for r in out["near_copies"].collect()} >= {0, 1, 3, 9, 90}
    assert {r.doc_id for r in out["near_copies"].collect()} - {r.doc_id for r in out["benchmark"].collect()} == {91}
    kept = [(r.doc_id, r.text) for r in out["benchmark"].collect()]
    check_packing(out["packing"].collect(), kept, 1024)
    assert public_tokenizers.path("byte_bpe_50k.json")


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    numbers = sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit())
    assert numbers == list(range(1, 14)) and "pipeline" in names
