"""Merging caches, the ledger, streams, and documents."""

import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from braidwork import CacheMode, Column, Ledger, Long, MergeCache, ParquetCache, Schema, String, TableCache, node
from braidwork.lineage.catalog import Catalog, graph_records, positions
from braidwork.lineage.dbml import build_dbml, build_erd_svg
from braidwork.operators.merge import CHANGED, merge_rows
from braidwork.plans.plan import Plan
from braidwork.sources import files, source
from braidwork.streaming import file_stream, for_each_batch, run_stream


@pytest.fixture
def at(tmp_path):
    return f"file://{tmp_path}"


def step(name, *deps, cache=None, body=None, **how):
    def f(**frames):
        return body(**frames) if body else next(iter(frames.values()))

    f.__name__ = name
    return node(type="pyspark", dependencies=list(deps), cache=cache, key=name, **how)(f)


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def rows(spark, *values):
    return spark.createDataFrame([(v, v * 10) for v in values], "id long, score long")


def pairs(ledger, spark):
    return sorted((r["source"], r["destination"]) for r in ledger.read(spark).collect())


def generator(spark):
    def make(start=1, n=3):
        return rows(spark, *range(start, start + n))

    return node(type="pyspark", key="gen")(make)


def test_merge_rows(spark):
    now = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "id long, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C"), (None, "m")], "id long, v string").withColumn("w", F.lit(1))
    out = sorted(((r["id"] or 0), r["v"], r["w"]) for r in merge_rows(now, new, ["id"]).collect())
    assert out == [(0, "m", 1), (0, "n", None), (1, "a", None), (2, "B", 1), (3, "C", 1)]
    with pytest.raises(PySparkException, match="repeat the key"):
        merge_rows(now, new.unionAll(new), ["id"]).collect()


def test_merge_is_idempotent_and_versions_stay_readable(spark, at):
    cache = MergeCache(f"{at}/t", ["id"], f"{at}/l")
    assert not cache.exists(spark)
    cache.write(spark, rows(spark, 1, 2))
    old = cache.table(spark)
    for _ in range(2):
        cache.write(spark, rows(spark, 2, 3))
    assert ids(cache.table(spark)) == [1, 2, 3] and ids(old) == [1, 2] and cache.versions(spark) == [1, 2, 3]
    cache.vacuum(spark, keep=1)
    assert cache.versions(spark) == [3] and ids(cache.table(spark)) == [1, 2, 3]
    cache.drop(spark)
    assert not cache.exists(spark)
    with pytest.raises(TypeError):
        MergeCache(at, "id", at)
    with pytest.raises(ValueError):
        MergeCache(at, [], at)


def test_a_failed_write_leaves_the_last_version(spark, at):
    cache = MergeCache(f"{at}/t", ["id"], f"{at}/l")
    cache.write(spark, rows(spark, 1))
    with pytest.raises(PySparkException):
        cache.write(spark, rows(spark, 5, 5))
    assert ids(cache.table(spark)) == [1]
    cache.write(spark, rows(spark, 2))
    assert ids(cache.table(spark)) == [1, 2]


def test_ledger(spark, at):
    ledger = Ledger(f"{at}/l")
    assert ledger.last(spark, "a", "b") is None
    ledger.create(spark)
    early, late = datetime.datetime(2025, 1, 1), datetime.datetime(2025, 1, 2)
    ledger.append(spark, ["a", "c"], "b", late)
    ledger.append(spark, ["a"], "b", early)
    assert ledger.last(spark, "a", "b") == late and ledger.last(spark, "b", "a") is None
    ledger.compact(spark)
    assert pairs(ledger, spark) == [("a", "b"), ("c", "b")] and ledger.last(spark, "a", "b") == late


@pytest.mark.parametrize("workers", [1, 2])
def test_only_new_rows_go_on(spark, at, workers):
    ledger, gen = Ledger(f"{at}/l"), generator(spark)
    b_cache, a_cache = MergeCache(f"{at}/b", ["id"], ledger), MergeCache(f"{at}/a", ["id"], ledger)
    b = step("b", gen, cache=b_cache)
    a = step("a", b, cache=a_cache)
    how = {"cache": {b: CacheMode.MERGE, a: CacheMode.MERGE}, "max_workers": workers}
    assert ids(a.run(spark, parameters={gen: {"start": 1, "n": 3}}, **how)) == [1, 2, 3]
    assert ids(a.run(spark, parameters={gen: {"start": 4, "n": 2}}, **how)) == [4, 5]
    assert ids(a_cache.table(spark)) == ids(b_cache.table(spark)) == [1, 2, 3, 4, 5]
    assert set(pairs(ledger, spark)) == {("b", "a")}


def test_warm_plain_caches_and_their_ledger(spark, at):
    ledger, gen = Ledger(f"{at}/l"), generator(spark)
    b = step("b", gen, cache=MergeCache(f"{at}/b", ["id"], ledger))
    a = step("a", b, cache=MergeCache(f"{at}/a", ["id"], ledger))
    assert ids(a.run(spark)) == [1, 2, 3] and pairs(ledger, spark) == [("b", "a")]
    assert ids(a.run(spark, parameters={gen: {"start": 9}})) == [1, 2, 3]
    plain = step("plain", b)
    assert ids(plain.run(spark)) == [1, 2, 3] and pairs(ledger, spark) == [("b", "a")]


def test_chain_ledger_and_uncached_links(spark, at):
    ledger, gen = Ledger(f"{at}/l"), generator(spark)
    cache = lambda n: MergeCache(f"{at}/{n}", ["id"], ledger)
    d = step("d", gen, cache=cache("d"))
    c = step("c", d)
    a = step("a", c.alias("x"), d.alias("y"), cache=cache("a"), body=lambda x, y: x.join(y.select("id"), "id"))
    modes = dict.fromkeys((d, a), CacheMode.MERGE)
    assert ids(a.run(spark, cache=modes)) == [1, 2, 3]
    assert pairs(ledger, spark) == [("d", "a")]


def test_two_owners_see_their_own_news(spark, at):
    ledger, gen = Ledger(f"{at}/l"), generator(spark)
    cache = lambda n: MergeCache(f"{at}/{n}", ["id"], ledger)
    top_cache = cache("top")
    top = step("top", gen, cache=top_cache)
    mid = step("mid", top)
    left = step("left", mid, cache=cache("left"))
    left.run(spark, cache=dict.fromkeys((top, left), CacheMode.MERGE))
    top_cache.write(spark, rows(spark, 7))
    right = step("right", mid, cache=cache("right"))
    end = step("end", left, right, body=lambda left, right: right.join(left.select("id"), "id", "left"))
    got = end.run(spark, cache=dict.fromkeys((left, right), CacheMode.MERGE))
    assert ids(got) == [1, 2, 3, 7] and ids(left.cache.table(spark)) == [1, 2, 3, 7]


def test_history_is_strict_and_static_edges_ignore_it(spark, at):
    ledger = Ledger(f"{at}/l")
    cache = MergeCache(f"{at}/b", ["id"], ledger)
    when = datetime.datetime(2025, 1, 1)
    stamped = rows(spark, 1, 2).withColumn(CHANGED, F.when(F.col("id") == 1, F.lit(when)).otherwise(F.lit(when + datetime.timedelta(seconds=1))).cast("timestamp_ntz"))
    cache.write(spark, stamped)
    ledger.append(spark, ["b"], "a", when)
    b = step("b", generator(spark), cache=cache)
    assert ids(step("a", b).run(spark)) == [2] and ids(step("a", b.static()).run(spark)) == [1, 2] and ids(step("other", b).run(spark)) == [1, 2]


def test_plain_caches(spark, at):
    for cache in (ParquetCache(f"{at}/p"), TableCache("plain_cache_table")):
        n = step("n", generator(spark), cache=cache)
        assert not cache.exists(spark) and ids(n.run(spark)) == [1, 2, 3] and cache.exists(spark)
        assert ids(n.run(spark)) == [1, 2, 3]
    spark.sql("DROP TABLE plain_cache_table")


def test_stream(spark, at, tmp_path):
    rows(spark, 1, 2, 3).write.json(f"{at}/in")
    arrivals = source("arrivals", lambda s: s.read.json(f"{at}/in"))
    cache = MergeCache(f"{at}/t", ["id"], f"{at}/l")
    merged = step("merged", arrivals, cache=cache)
    go = lambda: run_stream(file_stream(spark, f"{at}/in", "id long, score long"), merged, arrivals, f"{at}/check", cache={merged: CacheMode.MERGE}).awaitTermination()
    go()
    rows(spark, 3, 4).write.mode("append").json(f"{at}/in")
    go()
    assert ids(cache.table(spark)) == [1, 2, 3, 4]


def test_batches_are_done_once(spark, at):
    seen = []
    src = source("src", lambda s: None)
    run = for_each_batch(step("end", src), src, sink=lambda df, k: seen.append((k, ids(df))), done=f"{at}/done")
    for k in (0, 0, 1):
        run(rows(spark, k), k)
    assert seen == [(0, [0]), (1, [1])]


def test_filter_reaches_the_scan(spark, at):
    rows(spark, *range(50)).write.parquet(f"{at}/data")
    src = files(f"{at}/data", name="data")
    out = step("end", src.preprocess(lambda df: df.where("id > 40")).select("id")).run(spark)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,40)]" in plan and "ReadSchema: struct<id:bigint>" in plan


def documented():
    a = step("A", tags=["bronze"], description="Alpha", output=Schema(Column("k", Long(), "the key", pk=True)), group="G")
    b = step("B", a.select("k"), tags=["gold"], output=Schema(Column("k2", Long()).one_to_one(a.ref.k), Column("t", String(), "text")))
    return a, b, step("C", b, a.static())


def test_catalog(tmp_path):
    a, b, c = documented()
    catalog = Catalog()
    catalog.register_node(c)
    record = {r["name"]: r for r in catalog.get_nodes()}
    assert list(record) == ["C", "B", "A"] and record["A"]["successors"] == ["B", "C"] and record["C"]["predecessorsStatic"] == ["A"]
    assert record["B"]["predecessorColumns"] == {"A": ["k"]} and record["B"]["output"][1] == {"column": "t", "type": "String", "description": "text"}
    assert record["A"]["isActive"] and not record["A"]["hasCache"] and record["A"]["filePath"].endswith("test_changes.py") and "def documented" in record["A"]["sourceCode"]
    assert catalog.get_groups() == [{"id": "g", "name": "G", "nodes": ["A"]}]
    assert catalog.get_tag_suggestions() == [{"id": "bronze", "name": "bronze"}, {"id": "gold", "name": "gold"}]
    assert catalog.get_count_box_defs() == [{"label": "nodes", "count": 3}, {"label": "bronze", "count": 1}, {"label": "silver", "count": 0}, {"label": "gold", "count": 1}]
    assert catalog.search("alpha") == ["A"] and catalog.search("k text") == [] and catalog.search("t") != []
    assert "def B(A):" in catalog.code_template("B") and compile(catalog.code_template("B"), "x", "exec")
    page = c.html(f"{tmp_path}/c.html")
    assert "<svg" in page and "http" not in page.split('<script')[0] and open(f"{tmp_path}/c.html").read() == page


def test_positions_and_records():
    t1 = step("t1")
    t2, t3 = step("t2", t1), step("t3", t1)
    plan = Plan(step("t4", t2.select("x"), t3))
    assert positions(plan) == {"t1": [1.0, 50.0], "t2": [2.0, 30.83], "t3": [2.0, 64.16], "t4": [3.0, 50.0]}
    nodes, edges = graph_records(plan)
    assert len(nodes) == 4 and {"source": "t2", "target": "t4", "active": True, "columns": ["x"]} in edges


def test_dbml(tmp_path):
    a, b, c = documented()
    text = build_dbml(b, path=f"{tmp_path}/x.dbml", colors={"gold": "#fc0"})
    assert "k Long() [pk, note: '''the key''']" in text and "Ref: b.k2 - a.k" in text and "Table b [headercolor: #fc0] {" in text and "Managed by node `A`" in text
    assert build_dbml(step("x")) is None and build_dbml(c, only_nodes_with_cache=True) is None
    only = build_dbml(c, only_nodes_with_tags="bronze")
    assert "Table a" in only and "Table b" not in only and "Ref" not in only
    with pytest.raises(RuntimeError):
        build_erd_svg(b, f"{tmp_path}/x.svg")


def test_two_writers_lose_nothing(spark, tmp_path):
    from threading import Thread

    at = f"file://{tmp_path}/both"
    caches = [MergeCache(at, ["k"], f"file://{tmp_path}/ledger") for _ in range(3)]
    caches[0].write(spark, spark.createDataFrame([(0, 0)], "k long, v long"))
    threads = [Thread(target=c.write, args=(spark, spark.createDataFrame([(k + 1, k)], "k long, v long"))) for k, c in enumerate(caches)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(r["k"] for r in caches[0].table(spark).collect()) == [0, 1, 2, 3]
    assert caches[0].versions(spark) == [1, 2, 3, 4]
    caches[0].vacuum(spark, 1)
    assert caches[0].versions(spark) == [4]
    caches[0].vacuum(spark, 0)
    assert not caches[0].exists(spark)


def test_reader_between_stamp_and_commit_sees_the_rows_later(spark, tmp_path):
    from types import SimpleNamespace

    source, target = SimpleNamespace(key="a"), SimpleNamespace(key="b")
    ledger = Ledger(f"file://{tmp_path}/ledger")
    first, last = (MergeCache(f"file://{tmp_path}/{x}", ["k"], ledger) for x in ("first", "last"))
    first.write(spark, spark.createDataFrame([(1, 1)], "k long, v long"))
    stamped = datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
    taken = first.read(spark, source, target).select("k", "v")
    started = stamped + datetime.timedelta(hours=1)  # the reader starts after the stamp, before the commit
    last.write(spark, taken, [source], target, started)
    late = spark.createDataFrame([(2, 2)], "k long, v long").withColumn("cdc_datetime_updated", F.lit(stamped).cast("timestamp_ntz"))
    first.write(spark, late)
    assert [r["k"] for r in first.read(spark, source, target).collect()] == [2]
    ledger.compact(spark)
    assert [r["k"] for r in first.read(spark, source, target).collect()] == [2] and ledger.read(spark).count() == 1


def test_types_behind_a_pandas_node(spark):
    import pandas as pd

    from braidwork import Column, Integer, Schema, String, node

    @node(type="pandas", output=Schema(Column("a", Integer()), Column("b", String()), Column("c", String())))
    def made():
        return pd.DataFrame({"a": [1, None], "b": [None, None], "c": ["x", None]})

    @node(type="pyspark", dependencies=[made])
    def whole(made):
        return made

    @node(type="pyspark", dependencies=[made.select("a", "b")])
    def some(made):
        return made

    assert [f.dataType.simpleString() for f in whole.run(spark).schema] == ["int", "string", "string"]
    out = some.run(spark)
    assert [f.dataType.simpleString() for f in out.schema] == ["int", "string"] and sorted(map(str, (r["a"] for r in out.collect()))) == ["1", "None"]


def test_target_is_what_was_stored(spark, tmp_path):
    @node(type="pyspark", cache=ParquetCache(f"file://{tmp_path}/drawn"))
    def drawn():
        return spark.range(20).withColumn("r", F.rand())

    out = drawn.run(spark)
    assert sorted(out.collect()) == sorted(spark.read.parquet(f"file://{tmp_path}/drawn").collect())
