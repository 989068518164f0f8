"""Each stage on its own input, against plain versions."""

import numpy as np
from pyspark.sql import functions as F
from test_near import brute
from test_spans import brute as spans

import corpus_pipeline
from mossgraph.llm import automaton, pieces, raking
from mossgraph.llm.common import stored


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    rows, out = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in out.collect()}
        out = stored(stage(spark, out, sf))
        rows[name] = before, [r for r in out.collect()]
        assert name == "encoding" or out.columns == names
    before, after = rows["quality"]
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    kept = {r.doc_id for r in after}
    assert all(before[r.doc_id] == r for r in after) and len(kept & good) > 0.97 * len(good)
    before, after = rows["near_dedup"]
    assert sorted(r.doc_id for r in after) == [i for i, _, _, stays in brute([(i, r.text) for i, r in before.items()]) if stays]
    before, after = rows["secrets"]
    assert len(after) == len(before) and sum(r.text != before[r.doc_id].text for r in after) == sum(bool(spans(r.text)) for r in before.values())
    assert not any(k < 3 for r in after for _, k, _ in spans(r.text)) and all(r.n_chars == len(r.text) for r in after)
    before, after = rows["mixing"]
    sampled = {r.doc_id for r in raking.probabilities(spark.createDataFrame(list(before.values()), docs.schema)).where("sampled").collect()}
    assert {r.doc_id for r in after} == sampled
    before, after = rows["encoding"]
    code = pieces.encoder(pieces.default_model())
    assert {r.doc_id for r in after} == set(before)
    for r in after:
        text = before[r.doc_id].text
        assert code.decode(np.array(r.ids, np.uint32).tobytes()).decode() == (" " + text if text else "")
    assert automaton.BASE_RULES[0][0] == "assign" and corpus_pipeline.ORACLE_SQL is None


def test_stages_on_odd_rows(spark, sf):
    """Nulls in every column, empty, repeated and giant texts, and columns with names that stages use, through each stage by itself."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    giant = "every giant text has many words 0123456789abcdef0123456789 " * 900
    odd = [(None, "a text without an id, of more than five words", "en", "s", 3), (None, None, None, None, None), (None, "", None, "s", 0), (9001, None, "en", None, 0), (9002, giant, None, "s", len(giant)), (9002, giant, None, "s", len(giant)), (9003, " \n ", "de", "s", 3), (9004, "password = hunter2hunter2", "de", "s", 24)]
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars int").withColumn("n_chars", F.col("n_chars").cast(docs.schema["n_chars"].dataType)))
    names = ["__text", "__score", "__id", "__mark", "__source", "__p", "__row", "parts", "score", "spans", "component", "kept", "w"]
    rows = stored(rows.withColumns({n: F.lit(n) for n in names}))
    key = lambda r: (str(r.doc_id), r.text or "")
    before = sorted(map(key, rows.collect()))
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, rows, sf)
        if name == "encoding":
            whole = {}
            for r in got.where("part = 0").collect():
                whole[str(r.doc_id)] = whole.get(str(r.doc_id), 0) + 1
            assert sum(whole.values()) == len(before) and whole["9002"] == 2 and whole["None"] == 3
            continue
        assert got.columns == rows.columns, name
        after = got.collect()
        assert all(r[n] == n for r in after for n in names)
        if name == "secrets":
            assert len(after) == len(before) and {r.text for r in after if r.doc_id == 9004} == {"[assign]"} and all(r.n_chars == len(r.text or "") for r in after)
        else:
            assert set(map(key, after)) <= set(before)
        if name == "near_dedup":
            assert sum(r.doc_id == 9002 for r in after) == 2 and sum(r.doc_id is None for r in after) == 3
        assert stage(spark, rows.limit(0), sf).count() == 0
