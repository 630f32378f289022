"""The pipeline's stages in turn, on hard rows."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from cubespark.llm.mixing import mixing_plan


def test_stages(spark, hard):
    hard = hard.withColumn("lang", F.when(F.col("lang").isNotNull(), "en"))  # one language, which is likelier than none
    docs, seen = hard, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, "")
        seen[name] = docs
        if name != "pack":
            assert docs.columns == before.columns
    ids = {k: Counter(r.doc_id for r in v.select("doc_id").collect()) for k, v in seen.items()}
    letters = Counter(r.doc_id for r in hard.collect() if any(c.isalpha() for c in r.text or ""))
    assert ids["language"] == letters and not {100, 101, 102} & set(letters)
    assert 107 in ids["exact"] and 104 not in ids["exact"] and 105 not in ids["exact"] and 106 in ids["exact"]
    assert 108 in ids["near"] and 109 not in ids["near"]
    assert set(ids["mix"]) == set(ids["near"])  # each document once at least
    plan, _ = mixing_plan(seen["near"], target_entropy=0.95, max_repetition=2.0)
    assert max(ids["mix"].values()) <= 2 + 1 and plan.count() > 1
    assert set(ids["pack"]) == set(ids["mix"])


def test_repeated_ids(spark):
    """No stage before the mixture loses the only row of a text."""
    text = {x: " ".join(f"{x}word{i}" for i in range(30)) for x in "abcd"}
    rows = [(1, text["a"]), (2, text["a"].upper()), (1, text["b"]), (3, text["c"]), (3, text["c"]), (None, text["d"]), (4, text["d"]), (5, None)]
    docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, "")
    assert sorted((r.doc_id, r.text.lower()) for r in docs.collect()) == [(1, text["b"]), (2, text["a"]), (3, text["c"]), (4, text["d"])]


def test_run(spark, data):
    out = corpus_pipeline.run(spark, data)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns) and out.count() > 0


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))
