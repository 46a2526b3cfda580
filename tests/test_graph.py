"""Nodes, plans and execution."""

import random
import sys
import threading

import pandas as pd
import pytest
from pyspark.sql import functions as F

from braidwork import Cache, CacheMode, Column, Integer, Long, PreprocessMode, Schema, String, config_context, node, node_function
from braidwork.errors import CycleError, MissingColumnsError
from braidwork.operators.execute import Run
from braidwork.plans.node import NodeKind
from braidwork.plans.plan import Plan, RunStatus
from braidwork.sources import frame, table


class Held(Cache):
    """A cache in memory that counts its calls."""

    def __init__(self, value=None):
        self.value, self.calls = value, {"read": 0, "write": 0, "exists": 0}

    def read(self, *spark, from_node=None, to_node=None, is_static=False):
        self.calls["read"] += 1
        return self.value

    def write(self, *args, upstream_nodes=None, to_node=None, datetime_started_transformation=None):
        self.calls["write"] += 1
        self.value = args[-1]

    def exists(self, *spark):
        self.calls["exists"] += 1
        return self.value is not None


def made(name, *deps, cache=None, body=None, type="pandas", **how):
    def f(**frames):
        return body(**frames) if body else pd.DataFrame({"a": [1]})

    f.__name__ = name
    return node(type=type, dependencies=list(deps), cache=cache, key=name, **how)(f)


def test_run_in_pandas():
    one = made("one", body=lambda: pd.DataFrame({"b": [1, 2], "a": [3, 4], "c": [5, 6]}))
    two = made("two", one.select("b", "a").alias("x"), body=lambda x: x.assign(n=x.columns.tolist()[0]))
    out = two.run()
    assert out.columns.tolist() == ["a", "b", "n"] and set(out["n"]) == {"a"}


def test_declarations():
    with pytest.raises(ValueError):
        made("x", type="polars")
    with pytest.raises(TypeError):
        made("x", cache=object())
    with pytest.raises(ValueError):
        made("x", 5)
    a = made("a")
    with pytest.raises(ValueError):
        made("x", a, a.select("b"))
    with pytest.raises(ValueError):
        made("x", a.alias("q"), made("b").alias("q"))
    with pytest.raises(ValueError):
        a.select("x", "x")
    for bad in ((), (5,)):
        with pytest.raises(ValueError):
            a.preprocess(*bad)
    with config_context(require_node_description=True):
        with pytest.raises(ValueError):
            made("x")
        assert made("x", description="here").description == "here"
    assert a == made("a") and len({a, made("a")}) == 1 and a.kind is NodeKind.TRANSFORMATION and a() is not None


def test_dotted_names_become_arguments(spark):
    spark.createDataFrame([(1,)], "c long").createOrReplaceTempView("some_view")
    src = table("some_view")
    assert src.kind is NodeKind.DATASOURCE and "datasource" in src.tags and src.key == table("some_view").key
    assert src.alias("db.x").argument == "db.x" and table("db.tab").select("c").argument == "db_tab"
    with pytest.raises(ValueError):
        src.run()
    assert made("y", src, type="pyspark", body=lambda some_view: some_view).run(spark).columns == ["c"]


def test_output_is_enforced(spark):
    out = made("o", body=lambda: pd.DataFrame({"x": ["1"], "a": [1.5], "z": [0]}), output=Schema(Column("a", Integer()), Column("x", String()))).run()
    assert out.columns.tolist() == ["a", "x"] and out["a"].tolist() == [1]
    with pytest.raises(MissingColumnsError):
        made("o", body=lambda: pd.DataFrame({"x": [1]}), output=Schema(Column("a", Integer()))).run()


def test_every_kind_reads_every_kind(spark):
    bodies = {"pandas": lambda up: up.assign(b=up["a"] + 1), "pyspark": lambda up: up.withColumn("b", F.col("a") + 1), "pandas_on_spark": lambda up: up.assign(b=up["a"] + 1), "spark_sql": lambda up: f"SELECT a, a + 1 AS b FROM {up}"}
    for first in bodies:
        base = frame("base", pd.DataFrame({"a": [1, 2]}))
        one = made("one", base.alias("up"), type=first, body=bodies[first])
        for second in bodies:
            two = made("two", one.select("a").alias("up"), type=second, body=bodies[second])
            last = made("last", two.alias("up"), type="pandas", body=lambda up: up)
            assert sorted(last.run(spark)["b"].tolist()) == [2, 3]
    assert not [t for t in spark.catalog.listTables() if "__up__" in t.name]
    assert made("p", made("ps", frame("base", pd.DataFrame({"a": [1]})).alias("up"), type="pandas_on_spark", body=lambda up: up).alias("up"), type="pandas_on_spark", body=lambda up: up).run(spark, pandas_on_spark_use_pandas=True).__class__ is pd.DataFrame
    with pytest.raises(ValueError):
        made("q", type="spark_sql", body=lambda: "SELECT 1").run()


def test_consumers_cannot_disturb_each_other():
    src = made("src", body=lambda: pd.DataFrame({"a": [1]}))

    def spoil(src):
        src["a"] = 99
        return src

    left, right = made("left", src, body=spoil), made("right", src, body=lambda src: src)
    out = made("end", left, right, body=lambda left, right: pd.concat([left, right])).run()
    assert out["a"].tolist() == [99, 1]


def test_selection_reaches_below_the_conversion(spark):
    wide = made("wide", type="pyspark", spark_context=True, body=lambda spark: spark.range(3).select("id", F.raise_error(F.lit("read")).alias("never")))
    assert made("end", wide.select("id"), body=lambda wide: wide).run(spark)["id"].tolist() == [0, 1, 2]


def test_preprocess_and_its_switches():
    src = made("src", body=lambda: pd.DataFrame({"a": [1, 2, 3]}))
    keep = lambda df: df[df["a"] > 1]
    end = made("end", src.preprocess(keep, lambda df: df.assign(a=df["a"] * 10)).select("a"), body=lambda src: src)
    assert end.run()["a"].tolist() == [20, 30]
    for off in (PreprocessMode.DISABLE, {end: {src: PreprocessMode.DISABLE}}):
        assert end.run(preprocess=off)["a"].tolist() == [1, 2, 3]
    plain = made("plain", src, body=lambda src: src)
    with config_context(default_dependencies_preprocess_module=__name__, default_dependencies_preprocess_function="last_row"):
        assert plain.run()["a"].tolist() == [3]
        assert end.run()["a"].tolist() == [20, 30]
        assert made("off", src.preprocess(PreprocessMode.DISABLE), body=lambda src: src).run()["a"].tolist() == [1, 2, 3]
    with config_context(default_dependencies_preprocess_module="no.such", default_dependencies_preprocess_function="x"):
        assert plain.run()["a"].tolist() == [1, 2, 3]


def last_row(df):
    return df.tail(1)


def test_parameters_and_provided_inputs():
    def broken():
        raise RuntimeError

    top = made("top", body=broken)
    src = made("src", top.alias("t"), body=lambda t: t)
    end = made("end", src, body=lambda src, k=0: src.assign(b=src["a"] + k))
    given = pd.DataFrame({"a": [1]})
    assert end.run(inputs={src: given}, parameters={end: {"k": 5}})["b"].tolist() == [6]
    assert end.run(inputs={src: given}, parameters={end: {"src": pd.DataFrame({"a": [7]})}})["b"].tolist() == [7]
    assert end.run(inputs={end: given}) is not given
    plan = Plan(end, inputs={src: given})
    assert {k: v.status for k, v in plan.vertices.items()} == {"end": RunStatus.ACTIVE, "src": RunStatus.PROVIDED_INPUT, "top": RunStatus.SKIP}
    assert plan.levels() == [["src"], ["end"]]


def test_node_functions_know_what_is_asked():
    src = made("src", body=lambda: pd.DataFrame({"a": [1], "b": [2], "c": [3]}))
    asked = []

    @node_function(requested_columns=True, dependencies=[src])
    def maker(requested_columns, add=0):
        asked.append(requested_columns)
        inner = made("inner", src.select(*(requested_columns or ["a"])), body=lambda src: src + add)
        return [inner, made("outer", inner, body=lambda inner: inner)]

    x, y = made("x", maker.select("c"), body=lambda maker: maker), made("y", maker.select("a"), body=lambda maker: maker)
    end = made("end", x, y, body=lambda x, y: pd.concat([x, y], axis=1))
    params = {maker: {"add": 10}}
    out = end.run(parameters=params)
    assert asked == [["a", "c"]] and out.iloc[0].to_dict() == {"a": 11, "c": 13} and params == {maker: {"add": 10}}
    assert maker.run().columns.tolist() == ["a"] and asked[-1] is None


def test_node_function_errors():
    a, b = made("a"), made("b")
    inner = lambda *deps: made("inner", *deps, body=lambda **k: None)
    for returned, declared in (([inner(b)], [a]), ([inner()], [a]), ([], []), ([node_function()(lambda: None)], [])):
        with pytest.raises(ValueError):
            Plan(node_function(dependencies=declared)(lambda returned=returned: returned))
    with pytest.raises(ValueError):
        node_function(dependencies=[a.select("x")])(lambda: None)
    s, t = Schema(Column("x", Long())), Schema(Column("y", Long()))
    with pytest.raises(ValueError):
        Plan(node_function(output=s)(lambda: made("i", output=t)))
    plan = Plan(node_function(output=s)(lambda: made("i")))
    assert plan.node(plan.target.key).output_schema.get_column_names() == ["x"]


@pytest.mark.parametrize("mode,there,given,expected", [
    (None, False, False, (True, 0, 1, 1)), (None, True, False, (False, 1, 0, 1)), (CacheMode.DISABLE, False, False, (True, 0, 0, 0)),
    (CacheMode.DISABLE, True, False, (True, 0, 0, 0)), (CacheMode.MERGE, False, False, (True, 0, 1, 0)), (CacheMode.MERGE, True, False, (True, 0, 1, 0)),
    (None, True, True, (False, 0, 0, 0)), (CacheMode.MERGE, True, True, (False, 0, 0, 0)), (CacheMode.DISABLE, False, True, (False, 0, 0, 0)),
])
def test_cache_truth_table(mode, there, given, expected):
    ran = []
    cache = Held(pd.DataFrame({"a": [5]}) if there else None)

    def body():
        ran.append(1)
        return pd.DataFrame({"a": [1]})

    n = made("n", cache=cache, body=body)
    n.run(cache={n: mode} if mode else None, inputs={n: pd.DataFrame({"a": [9]})} if given else None)
    assert (bool(ran), cache.calls["read"], cache.calls["write"], cache.calls["exists"]) == expected


def test_cold_cache_is_read_by_each_consumer_and_skipped_ones_are_not_asked():
    top, mid = Held(), Held(pd.DataFrame({"a": [1]}))
    base = made("base", cache=top)
    left, right = made("left", base, body=lambda base: base), made("right", base, body=lambda base: base)
    made("end", left, right, body=lambda left, right: left).run()
    assert top.calls == {"read": 2, "write": 1, "exists": 1}
    other = Held()
    made("end", made("warm", made("hidden", cache=other), cache=mid, body=lambda hidden: hidden), body=lambda warm: warm).run()
    assert other.calls["exists"] == 0 and mid.calls == {"read": 1, "write": 0, "exists": 1}


def test_results_are_let_go():
    up = made("n0")
    for k in range(1, 7):
        up = made(f"n{k}", up.alias("up"), body=lambda up: up)
    run = Run(up)
    run.result()
    assert run.peak <= 2 and not run.results


@pytest.mark.parametrize("workers", [1, 4])
def test_random_graphs(workers):
    rng = random.Random(workers)
    for _ in range(30):
        n = rng.randint(2, 9)
        deps = {k: rng.sample(range(k), rng.randint(0, min(k, 3))) for k in range(n)}
        given, warm = ({k for k in range(n) if rng.random() < 0.15} for _ in range(2))
        ran, lock, nodes = [], threading.Lock(), {}
        for k in range(n):
            def body(k=k, **ups):
                with lock:
                    ran.append(k)
                return pd.DataFrame({"a": [1 + sum(f["a"][0] for f in ups.values())]})

            nodes[k] = made(f"g{k}", *(nodes[d] for d in deps[k]), cache=Held(pd.DataFrame({"a": [100 + k]})) if k in warm else None, body=body)
        value = {}
        for k in range(n):
            value[k] = 1000 + k if k in given else 100 + k if k in warm else 1 + sum(value[d] for d in deps[k])
        active, todo = set(), [n - 1]
        while todo:
            k = todo.pop()
            if k not in active and k not in given and k not in warm:
                active.add(k)
                todo += deps[k]
        out = nodes[n - 1].run(max_workers=workers, inputs={nodes[k]: pd.DataFrame({"a": [1000 + k]}) for k in given})
        assert out["a"].tolist() == [value[n - 1]] and sorted(ran) == sorted(active)


def test_failures_come_through():
    def broken(**_):
        raise KeyError("here")

    bad = made("bad", body=broken)
    for workers in (1, 3):
        with pytest.raises(KeyError):
            made("end", bad, made("ok"), body=lambda bad, ok: ok).run(max_workers=workers)


def test_config_reaches_workers():
    from braidwork import get_config

    seen = []
    ups = [made(f"u{k}", body=lambda: seen.append(get_config("catalog_count_box_tags")) or pd.DataFrame({"a": [1]})) for k in range(3)]
    with config_context(catalog_count_box_tags="mine", node_run_max_workers=3):
        made("end", *ups, body=lambda **f: f["u0"]).run()
    assert seen == ["mine"] * 3


def test_long_chains_and_many_diamonds():
    up = made("c0")
    for k in range(1, 2000):
        up = made(f"c{k}", up.alias("up"), body=lambda up: up)
    assert len(Plan(up).order) == 2000 and sys.getrecursionlimit() <= 3000
    up = made("d0")
    for k in range(60):
        a, b = made(f"a{k}", up.alias("up")), made(f"b{k}", up.alias("up"))
        up = made(f"d{k + 1}", a, b)
    plan = Plan(up)
    assert len(plan.order) == 181 and max(plan.depths()) == 121
    f = node_function()(lambda: made("f0i"))
    f.key = "f0"
    for k in range(1, 300):
        def make(f=f, k=k):
            return made(f"f{k}i", f.alias("up"))

        f = node_function(dependencies=[f], key=f"f{k}")(make)
    assert len(Plan(f).order) == 300


def test_cycles_are_found():
    a = made("a")
    b = made("b", a)
    a.edges = (b.select("x"),)
    with pytest.raises(CycleError):
        Plan(b)


def test_depths():
    t1, t2 = made("t1"), made("t2")
    t3 = made("t3", t1, t2)
    t4 = made("t4", t3, t2)
    assert {d: set(k) for d, k in Plan(made("t5", t4)).depths().items()} == {1: {"t1", "t2"}, 2: {"t3"}, 3: {"t4"}, 4: {"t5"}}


def test_no_extra_jobs(spark):
    src = frame("base", spark.range(10))
    one = made("one", src.alias("up"), type="pyspark", body=lambda up: up.where("id > 3"))
    two = made("two", one.alias("up"), type="spark_sql", body=lambda up: f"SELECT count(*) AS n FROM {up}", output=Schema(Column("n", Long())))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("quiet", "quiet")
    out = two.run(spark)
    assert list(tracker.getJobIdsForGroup("quiet")) == []
    spark.sparkContext._jsc.sc().clearJobGroup()
    assert out.first()["n"] == 6


def test_debug_tells_of_steps(capfd):
    import logging

    from braidwork.log import ColorFormatter

    made("told").run(debug=True)
    record = logging.LogRecord("braidwork", logging.ERROR, "", 0, "m", None, None)
    assert "\033[31mERROR" in ColorFormatter(True).format(record) and "\033" not in ColorFormatter(False).format(record)
    logger = logging.getLogger("braidwork")
    assert logger.level == logging.DEBUG and len(logger.handlers) == 1
    logger.setLevel(logging.NOTSET)
    logger.handlers.clear()
