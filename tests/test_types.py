"""Types, casts and schemas."""

import datetime
import decimal
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidwork import queries
from braidwork import (
    Binary, Boolean, Byte, Column, Date, DateFormat, DateTime, Decimal, Double, Float, Integer, Long, Schema, Short, String, Unknown, config_context, get_config, node,
)
from braidwork.errors import CastError, DataMismatchError, MissingColumnsError, NoSelectedColumnsError, SchemaMismatchError
from braidwork.functions.casts import conform_series, pandas_type_name
from braidwork.functions.types import logical_type, to_python_pattern, to_spark_pattern
from braidwork.operators.frames import FrameKind, conform, convert, frame_kind, from_pandas, select
from braidwork.testing import assert_dataframes_equals, assert_pyspark_df_equal, assert_schemas_are_equals


@pytest.mark.parametrize("kind", [Boolean, Byte, Binary, Short, Integer, Long, Float, Double, String, Date, DateTime])
def test_spark_types_are_recognised(kind):
    assert logical_type(kind().spark) == kind()


def test_other_types():
    assert logical_type(T.DecimalType(5, 1)) == Decimal(5, 1) and repr(Decimal()) == "Decimal(13, 2)"
    assert logical_type(T.ArrayType(T.LongType())) == Unknown() and logical_type(T.TimestampNTZType()) == Unknown()
    assert Long().key == "long" and str(String()) == "String()" and Date("dd") != Date("MM") and Long() != Short()


def test_patterns_go_both_ways():
    assert to_spark_pattern("%Y-%m-%d") == "yyyy-MM-dd" and to_python_pattern("yyyy-MM-dd H:m:s") == "%Y-%m-%d %H:%M:%S"
    assert to_spark_pattern("%dT%H") == "dd'T'H" and to_python_pattern("dd'T'H") == "%dT%H"
    assert Date("%d/%m/%Y", DateFormat.PYTHON).spark_format == "dd/MM/yyyy" and Date("dd/MM/yyyy").python_format == "%d/%m/%Y"
    for bad in ("%Q", "%c"):
        with pytest.raises(ValueError):
            to_spark_pattern(bad)
    with pytest.raises(ValueError):
        to_python_pattern("QQQ")


def test_spark_casts_give_null(spark):
    df = spark.createDataFrame([("123", "01/02/2024", "2024-01-02 3:4:5", 1.239), ("abc", "x", "y", None)], "a string, b string, c string, d double")
    out = conform(df, Schema(Column("a", Long()), Column("b", Date("dd/MM/yyyy")), Column("c", DateTime()), Column("d", Decimal(5, 2))))
    rows = out.collect()
    assert rows[0]["a"] == 123 and rows[0]["b"] == datetime.date(2024, 2, 1) and rows[0]["d"] == decimal.Decimal("1.24")
    assert rows[0]["c"] == datetime.datetime(2024, 1, 2, 3, 4, 5) and all(v is None for v in rows[1])
    assert out.columns == ["a", "b", "c", "d"]


def test_equal_type_names_are_not_cast(spark):
    df = spark.createDataFrame([(decimal.Decimal("1.55"),)], "a decimal(10,2)")
    assert conform(df, Schema(Column("a", Decimal(5, 1)))).schema["a"].dataType == T.DecimalType(10, 2)
    assert conform(df, Schema(Column("a", Unknown()))).schema == df.schema


def test_casts_that_cannot_work(spark):
    df = spark.createDataFrame([(datetime.date(2024, 1, 1), 5)], "a date, b long")
    for name, kind in (("a", Boolean()), ("b", DateTime()), ("b", Date())):
        with pytest.raises(CastError):
            conform(df, Schema(Column(name, kind)))


def test_one_projection(spark):
    df = spark.range(3).select(F.col("id").alias("a b"), F.lit("1").alias("c"), F.lit(2).alias("unused"))
    out = conform(df, Schema(Column("c", Long()), Column("a b", String())))
    assert out.columns == ["c", "a b"] and str(out._jdf.queryExecution().optimizedPlan()).count("Project") == 1


def test_pandas_casts():
    s = pd.Series([1.7, None, 3.2], dtype=object)
    assert conform_series(s, Integer()).tolist() == [1, pd.NA, 3]
    assert conform_series(pd.Series([1.239, 2.0]), Decimal(10, 2)).tolist() == [1.24, 2.0]
    assert conform_series(pd.Series([True, 0, None], dtype=object), Boolean()).tolist() == [True, False, None]
    with pytest.raises(CastError):
        conform_series(pd.Series([True, "no"], dtype=object), Boolean())
    days = conform_series(pd.Series(["2024-01-02", None], dtype=object), Date())
    assert days[0] == pd.Timestamp("2024-01-02") and pd.isna(days[1]) and str(days.dtype) == "datetime64[ns]"
    assert conform_series(pd.Series([1, 2]), String()).tolist() == ["1", "2"]
    assert conform_series(pd.Series(["x"]), Unknown()).tolist() == ["x"]
    with pytest.raises(ValueError):
        conform_series(pd.Series(["x"]), Long())
    assert pandas_type_name(pd.Series([1, 2])) == "Long" and pandas_type_name(pd.Series(["a", None])) == "String"


def test_conversions(spark):
    p = pd.DataFrame({"a": [1, 2], "b": ["x", "y"]})
    s = convert(p, FrameKind.PYSPARK, spark)
    ps = convert(s, FrameKind.PANDAS_ON_SPARK, spark)
    for f in (p, s, ps):
        for kind in FrameKind:
            out = convert(f, kind, spark)
            assert frame_kind(out) is kind
            assert convert(out, FrameKind.PANDAS, spark).reset_index(drop=True).equals(p)
    with pytest.raises(ValueError):
        convert(p, FrameKind.PYSPARK)
    with pytest.raises(TypeError):
        frame_kind([1])


def test_empty_pandas_frames(spark, caplog):
    empty = pd.DataFrame({"a": []})
    assert from_pandas(empty, spark).schema["a"].dataType == T.StringType() and "strings" in caplog.text
    assert from_pandas(empty, spark, Schema(Column("a", Boolean()))).schema["a"].dataType == T.BooleanType()
    assert conform(empty, Schema(Column("a", Boolean()))).columns.tolist() == ["a"]


def test_selection_minds_case(spark):
    df = spark.createDataFrame([(1, 2)], "My_Col long, other long")
    assert select(df, ["other"]).columns == ["other"]
    with pytest.raises(MissingColumnsError) as e:
        select(df, ["my_col", "nope", "other"])
    assert "Did you mean `My_Col`?" in str(e.value) and "not found" in str(e.value) and "found" in str(e.value)
    with pytest.raises(NoSelectedColumnsError):
        select(df, [])


def test_schema():
    s = Schema([Column("a", Long(), "first", pk=True), Column("b", String())])
    assert s.get_column_names() == ["a", "b"] and s.a.pk and s.get("b").type == String()
    assert s == Schema(Column("b", String()), Column("a", Long(), "first", pk=True)) and s != Schema(Column("a", Long()))
    assert not s.copy().reset().a.pk and s.a.pk
    assert s.struct()["a"].metadata == {"comment": "first", "pk": True, "logical_type": "Long()"}
    with pytest.raises(IndexError):
        Schema()


def test_views_and_relationships():
    @node(type="pandas", output=Schema(Column("k", Long(), pk=True)))
    def a():
        """A."""

    @node(type="pandas", output=Schema(a.output.k, Column("f", Long()).many_to_one(a.ref.k, "has")))
    def b():
        """B."""

    assert not b.output_schema.k.pk and a.ref.k.pk and not a.output.k.pk
    link = b.output_schema.f.get_foreign_key(a.ref.k)
    assert link.kind.value == "N:1" and link.description == "has"
    assert not b.ref.f.relationships and b.output_schema.k.key != a.output_schema.k.key
    with pytest.raises(ValueError):
        Schema(a.ref.k)
    with pytest.raises(ValueError):
        Column("x", Long()).one_to_one(a.output.k)
    with pytest.raises(ValueError):
        Column("x", Long()).one_to_one(a.ref.k).many_to_many(a.ref.k)
    Column("x", Long()).one_to_many(a.output_schema.k)


def test_pandas_without_the_session_s_arrow(spark):
    """Nulls, missing numbers and times arrive alike, whether the session converts by Arrow or row by row."""
    name = "spark.sql.execution.arrow.pyspark.enabled"
    times = pd.to_datetime(pd.Series(["2024-01-02 03:04:05.123456", None]))
    pdf = pd.DataFrame({"a": pd.array([1, None], "Int64"), "none": [None, None], "x": [0.5, float("nan")], "s": ["y", None], "t": times, "d": times - times[0], "l": [[1], None], "nat": pd.to_datetime(pd.Series([None, None])), "nan": [float("nan")] * 2, "c": pd.Categorical([None, None]), "`q.": [1, 2]})
    schema = Schema(Column("a", Integer()), Column("none", String()))
    with_arrow = from_pandas(pdf, spark, schema)
    spark.conf.set(name, "false")
    try:
        without, bare = from_pandas(pdf, spark, schema), from_pandas(pdf[["none"]], spark)
        core = queries.queries()["pandas_types"](spark, "/root/testdata/sf0.001") if os.path.isdir("/root/testdata/sf0.001") else None
        assert without.schema == with_arrow.schema and without.collect() == with_arrow.collect()
        assert without.schema["a"].dataType == T.IntegerType() and without.schema["none"].dataType == T.StringType() and without.collect()[1]["x"] is None
        assert bare.collect() == [(None,), (None,)] and [with_arrow.schema[c].dataType for c in ("nat", "nan")] == [T.TimestampType(), T.DoubleType()]
        assert core is None or core.where("note is null").count() == 25 and core.where("region is null").count() == 5
        assert [r["m"] for r in from_pandas(spark.sql("SELECT named_struct('k', 1) AS m, NULL AS none").toPandas(), spark).collect()] == [(1,)]
    finally:
        spark.conf.set(name, "true")


def test_config(monkeypatch):
    assert get_config("node_run_max_workers") == 1
    monkeypatch.setenv("BRAIDWORK_NODE_RUN_MAX_WORKERS", "3")
    monkeypatch.setenv("BRAIDWORK_REQUIRE_NODE_DESCRIPTION", "true")
    assert get_config("node_run_max_workers") == 3 and get_config("require_node_description") is True
    with config_context(node_run_max_workers=5):
        assert get_config("node_run_max_workers") == 5 and get_config("require_node_description") is True
    with pytest.raises(KeyError):
        get_config("nope")
    with pytest.raises(KeyError), config_context(nope=1):
        pass
    with config_context(require_schema_description=True), pytest.raises(ValueError):
        Column("a", Long())


def test_comparison_helpers(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    b = spark.createDataFrame([(2, "y"), (1, "x")], "k long, v string")
    assert_dataframes_equals(a, b)
    assert_pyspark_df_equal(a, b, order_by=["k"])
    with pytest.raises(DataMismatchError):
        assert_pyspark_df_equal(a.coalesce(1), b.coalesce(1), check_order=True)
    with pytest.raises(DataMismatchError):
        assert_dataframes_equals(a, spark.createDataFrame([(1, "x"), (2, "z")], "k long, v string"))
    with pytest.raises(SchemaMismatchError):
        assert_schemas_are_equals(a, a.select("k"))
    assert_dataframes_equals(pd.DataFrame({"a": [2, 1]}), pd.DataFrame({"a": [1, 2]}))
    with pytest.raises(DataMismatchError):
        assert_dataframes_equals(pd.DataFrame({"a": [2, 2]}), pd.DataFrame({"a": [1, 2]}))
