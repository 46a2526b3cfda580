"""The five stages on small inputs."""

from collections import Counter

from pyspark.sql import functions as F

from braidwork.llm import mixing
from braidwork.llm import pipeline as corpus_pipeline
from braidwork.llm import queries as llm


def test_stages(spark, tmp_path):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    long = lambda a, b: " ".join(words[a:b])
    item = long(200, 230)
    rows = [(1, long(0, 60)), (2, long(0, 60)), (3, long(0, 57) + " x y z"), (4, long(100, 140) + "\n" + item), (5, None), (6, "123"), (7, long(240, 300)), (8, long(60, 100))]
    docs = spark.createDataFrame([(k, t, "en", f"s{k % 2}", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out, held = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, str(tmp_path))
        held[name] = {r["doc_id"] for r in out.collect()}
        if name != "mixing":
            assert out.columns == docs.columns
    assert held["language ID"] == {1, 2, 3, 4, 7, 8}
    assert held["line dedup"] == {1, 4, 7, 8}
    assert held["benchmark decontamination"] == {1, 7, 8}
    assert held["mixing"] <= {1, 7, 8}
    final = corpus_pipeline.run(spark, str(tmp_path))
    copies = Counter(r["doc_id"] for r in final.collect())
    assert set(copies) == held["mixing"] and max(copies.values()) <= 3


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_duplicate_stage_keeps_one(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(3, text), (1, text), (2, text + " end"), (None, text), (9, "")], "doc_id long, text string").withColumn("kept", F.lit(False))
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "9", "None"] and kept.columns == docs.columns


def test_mixture_takes_each_row_as_drawn(spark):
    rows = [(None if k % 2 else 5, f"w{k} " * (3 + k % 2), "en", "ab"[k % 4 // 2] if k % 5 else None, 0) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    drawn = Counter()
    for r in mixing.mix(docs).collect():
        drawn[r["doc_id"], r["source"], r["size"]] += r["copies"]
    out = corpus_pipeline.mixture(spark, docs, "")
    taken = Counter((r["doc_id"], r["source"], len(r["text"].split())) for r in out.collect())
    assert out.columns == [*docs.columns, "copy"] and taken == +drawn and sum(taken.values()) > 20


def test_stages_with_clashing_columns(spark, tmp_path):
    rows = [(k, f"w{k} x{k} y{k} z{k} v{k} u{k}\nsame words here", "en", "s") for k in range(8)] + [(None, "a b c d e", "en", "s"), (None, "a b c d e", "en", "s"), (7, "q r s t", "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs = docs.withColumns({c: F.lit(c) for c in ("copy", "removed", "n_lines", "kept", "size", "component_id", "h", "doc", "line", "k1", "uid", "item_id", "copies")})
    spark.createDataFrame([(1, "v1 v2")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, str(tmp_path))
        held = out.collect()
        if name != "mixing":
            assert out.columns == docs.columns and {r["removed"] for r in held} == {"removed"}
        if name == "line dedup":  # a text of one id and its copy are one document
            assert len(held) == len(rows) and sum("same words" in r["text"] for r in held) == 1
    assert sorted(out.columns) == sorted(docs.columns) and min(r["copy"] for r in held) == 1


def test_run_leaves_only_its_result(spark, tmp_path):
    import glob

    rows = [(k, f"w{k} x{k} y{k} z{k} v{k} u{k}\nsame words here", "en", "s", 10) for k in range(8)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "v1 v2")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(glob.glob(f"{root}/pipeline-*/*"))
    corpus_pipeline.run(spark, str(tmp_path))
    assert [x.rsplit("-", 1)[-1] for x in set(glob.glob(f"{root}/pipeline-*/*")) - before] == ["mixing"]


def test_registry():
    names = list(llm.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 11)) and "pipeline" in names
    assert set(llm.oracle_sql()) <= set(names)
