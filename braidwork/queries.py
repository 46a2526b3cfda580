"""One query for each operator of the engine, with the DuckDB SQL that gives the same rows.

Each query builds a small graph over the test tables and runs it.  Joins,
aggregates, windows and so on are Spark's own, used inside nodes; their
queries show that they pass through a graph unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import (
    CacheMode, Column, Date, DateTime, Decimal, Double, Integer, Ledger, Long, MergeCache, ParquetCache, PreprocessMode, Schema, String, TableCache, config_context, node, node_function,
)
from .lineage.catalog import Catalog
from .lineage.dbml import build_dbml
from .operators.scratch import scratch
from .plans.plan import Plan
from .sources import files, frame, source
from .streaming import file_stream, run_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(sf_dir: str, name: str):
    return files(f"{sf_dir}/{name}.parquet", name=name)


def only_expensive(df: DataFrame) -> DataFrame:
    """The default preprocess function of the query below."""
    return df.where("o_totalprice > 200000")


# -- sources and sinks ---------------------------------------------------------


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_table(spark, sf_dir):
    view = "nation_" + scratch(spark, "v").rsplit("-", 1)[1]
    spark.read.parquet(f"{sf_dir}/nation.parquet").createOrReplaceTempView(view)

    @node(type="pyspark", dependencies=[source("nation_view", lambda s: s.table(view))])
    def nations(nation_view):
        return nation_view

    return nations.run(spark)


@query("SELECT a.c_custkey, a.c_name, b.c_acctbal FROM customer a JOIN customer b USING (c_custkey)")
def scan_consolidated(spark, sf_dir):
    customer = table(sf_dir, "customer")

    @node(type="pyspark", dependencies=[customer.select("c_custkey", "c_name").alias("c")])
    def names(c):
        return c

    @node(type="pyspark", dependencies=[customer.select("c_custkey", "c_acctbal").alias("c")])
    def balances(c):
        return c

    @node(type="pyspark", dependencies=[names, balances])
    def both(names, balances):
        return names.join(balances, "c_custkey")

    return both.run(spark)


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey < 20")
def provided_input(spark, sf_dir):
    customer = table(sf_dir, "customer")

    @node(type="pyspark", dependencies=[customer.select("c_name", "c_custkey")])
    def names(customer):
        return customer

    given = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_nationkey < 20")
    return names.run(spark, inputs={customer: given})


@query("SELECT r_regionkey, r_name FROM region")
def source_formats(spark, sf_dir):
    """Parquet to CSV and JSON and back, through two file sources."""
    at = scratch(spark, "formats")
    region = spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey", "r_name")
    region.write.option("header", True).csv(f"{at}/csv")
    region.write.json(f"{at}/json")
    schema = "r_regionkey int, r_name string"

    @node(type="pyspark", dependencies=[files(f"{at}/csv", "csv", name="as_csv", options={"header": True}, schema=schema), files(f"{at}/json", "json", name="as_json", schema=schema)])
    def both(as_csv, as_json):
        return as_csv.intersect(as_json)

    return both.run(spark)


# -- projection, schemas, casts ----------------------------------------------------


@query("SELECT c_custkey, c_name FROM customer")
def select_sorted(spark, sf_dir):
    @node(type="pyspark", dependencies=[table(sf_dir, "customer").select("c_name", "c_custkey")])
    def names(customer):
        return customer

    return names.run(spark)


@query("""SELECT CAST(l_quantity AS DECIMAL(13,2)) AS l_quantity, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(l_partkey AS VARCHAR) AS l_partkey FROM lineitem""")
def schema_project_cast(spark, sf_dir):
    output = Schema(Column("l_quantity", Decimal(13, 2)), Column("l_linenumber", Long()), Column("l_partkey", String()))

    @node(type="pyspark", dependencies=[table(sf_dir, "lineitem")], output=output)
    def items(lineitem):
        return lineitem

    return items.run(spark)


@query("SELECT p_partkey, TRY_CAST(p_brand AS BIGINT) AS p_brand, TRY_CAST(p_name AS DOUBLE) AS p_name FROM part")
def try_cast_null(spark, sf_dir):
    @node(type="pyspark", dependencies=[table(sf_dir, "part")], output=Schema(Column("p_partkey", Long()), Column("p_brand", Long()), Column("p_name", Double())))
    def parts(part):
        return part

    return parts.run(spark)


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def parse_date(spark, sf_dir):
    @node(type="pyspark", dependencies=[table(sf_dir, "orders").select("o_orderkey", "o_orderdate")], output=Schema(Column("o_orderkey", Long()), Column("day", Date("dd/MM/yyyy"))))
    def days(orders):
        return orders.withColumn("day", F.date_format("o_orderdate", "dd/MM/yyyy"))

    return days.run(spark)


@query("SELECT event_id, CAST(strftime(ts, '%Y-%m-%d %H:%M:%S') AS TIMESTAMP) AS at FROM events")
def parse_datetime(spark, sf_dir):
    @node(type="pyspark", dependencies=[table(sf_dir, "events").select("event_id", "ts")], output=Schema(Column("event_id", Long()), Column("at", DateTime())))
    def times(events):
        return events.withColumn("at", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))

    return times.run(spark).withColumn("at", F.col("at").cast("timestamp_ntz"))


# -- preprocess -----------------------------------------------------------------------


def _orders(sf_dir, *functions):
    edge = table(sf_dir, "orders").preprocess(*functions) if functions else table(sf_dir, "orders").select("o_orderkey", "o_totalprice")

    @node(type="pyspark", dependencies=[edge.select("o_orderkey", "o_totalprice")])
    def kept(orders):
        return orders

    return kept


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000")
def preprocess_filter(spark, sf_dir):
    return _orders(sf_dir, lambda df: df.where("o_orderstatus = 'O'"), lambda df: df.where("o_totalprice > 100000")).run(spark)


@query("SELECT o_orderkey, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_totalprice * 2 > 300000")
def preprocess_order(spark, sf_dir):
    return _orders(sf_dir, lambda df: df.withColumn("o_totalprice", F.col("o_totalprice") * 2), lambda df: df.where("o_totalprice > 300000")).run(spark)


@query("SELECT o_orderkey, o_totalprice FROM orders")
def preprocess_disabled(spark, sf_dir):
    return _orders(sf_dir, lambda df: df.where("o_orderstatus = 'O'")).run(spark, preprocess=PreprocessMode.DISABLE)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000")
def preprocess_default(spark, sf_dir):
    with config_context(default_dependencies_preprocess_module="braidwork.queries", default_dependencies_preprocess_function="only_expensive"):
        return _orders(sf_dir).run(spark)


# -- kinds of nodes ---------------------------------------------------------------------


@query("""SELECT l_returnflag, l_linestatus, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty,
  CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_price, COUNT(*) AS n_items
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
def sql_node(spark, sf_dir):
    @node(type="pyspark", dependencies=[table(sf_dir, "lineitem")])
    def shipped(lineitem):
        return lineitem.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))

    @node(type="spark_sql", dependencies=[shipped.select("l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice")])
    def summary(shipped):
        return f"""
            SELECT l_returnflag, l_linestatus, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty,
              CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_price, COUNT(*) AS n_items
            FROM {shipped} GROUP BY l_returnflag, l_linestatus"""

    return summary.run(spark)


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def pandas_node(spark, sf_dir):
    @node(type="pandas", dependencies=[table(sf_dir, "nation").select("n_name", "n_regionkey"), table(sf_dir, "region").select("r_name", "r_regionkey")])
    def named(nation, region):
        return nation.merge(region, left_on="n_regionkey", right_on="r_regionkey")[["n_name", "r_name"]]

    @node(type="pyspark", dependencies=[named])
    def result(named):
        return named

    return result.run(spark)


@query("SELECT s_suppkey, s_acctbal * 2 AS doubled FROM supplier WHERE s_acctbal > 0")
def pandas_on_spark_node(spark, sf_dir):
    @node(type="pandas_on_spark", dependencies=[table(sf_dir, "supplier").select("s_suppkey", "s_acctbal")])
    def doubled(supplier):
        out = supplier[supplier["s_acctbal"] > 0]
        out["doubled"] = out["s_acctbal"] * 2
        return out[["s_suppkey", "doubled"]]

    @node(type="pyspark", dependencies=[doubled])
    def result(doubled):
        return doubled

    return result.run(spark)


@query("SELECT upper(n_name) AS name, COUNT(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def mixed_types(spark, sf_dir):
    @node(type="pandas", dependencies=[table(sf_dir, "nation").select("n_nationkey", "n_name")])
    def upper(nation):
        return nation.assign(n_name=nation["n_name"].str.upper())

    @node(type="spark_sql", dependencies=[upper, table(sf_dir, "customer").select("c_nationkey")])
    def counts(upper, customer):
        return f"SELECT n_name AS name, COUNT(*) AS n FROM {customer} JOIN {upper} ON c_nationkey = n_nationkey GROUP BY n_name"

    return counts.run(spark)


@query("SELECT p_partkey, p_retailprice FROM part WHERE p_size > 10")
def node_function_columns(spark, sf_dir):
    part = table(sf_dir, "part")

    @node_function(requested_columns=True, dependencies=[part])
    def asked(requested_columns):
        @node(type="pyspark", dependencies=[part.select(*requested_columns)])
        def only(part):
            return part

        return only

    @node(type="pyspark", dependencies=[asked.select("p_partkey", "p_retailprice", "p_size")])
    def large(asked):
        assert asked.columns == ["p_partkey", "p_retailprice", "p_size"]
        return asked.where("p_size > 10").drop("p_size")

    return large.run(spark)


@query("SELECT (o_orderkey + 1) * 3 AS k FROM orders")
def node_function_series(spark, sf_dir):
    orders = table(sf_dir, "orders")

    @node_function(dependencies=[orders])
    def plus(step=1):
        @node(type="pyspark", dependencies=[orders.select("o_orderkey")])
        def keys(orders):
            return orders.select((F.col("o_orderkey") + step).alias("k"))

        return keys

    @node_function(dependencies=[plus])
    def times():
        @node(type="pyspark", dependencies=[plus])
        def middle(plus):
            return plus

        @node(type="pyspark", dependencies=[middle])
        def tripled(middle):
            return middle.select((F.col("k") * 3).alias("k"))

        return [middle, tripled]

    @node(type="pyspark", dependencies=[times])
    def last(times):
        return times

    return last.run(spark, parameters={plus: {"step": 1}})


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 45")
def parameters(spark, sf_dir):
    @node(type="pyspark", dependencies=[table(sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")])
    def large(lineitem, least=0):
        return lineitem.where(F.col("l_quantity") >= least)

    return large.run(spark, parameters={large: {"least": 45}})


@query("""SELECT o_custkey, COUNT(*) AS n, MAX(o_totalprice) AS top FROM orders GROUP BY o_custkey""")
def diamond(spark, sf_dir):
    @node(type="pyspark", dependencies=[table(sf_dir, "orders").select("o_custkey", "o_totalprice")])
    def base(orders):
        return orders

    @node(type="pyspark", dependencies=[base])
    def counts(base):
        return base.groupBy("o_custkey").agg(F.count("*").alias("n"))

    @node(type="pyspark", dependencies=[base])
    def tops(base):
        return base.groupBy("o_custkey").agg(F.max("o_totalprice").alias("top"))

    @node(type="pyspark", dependencies=[counts, tops])
    def both(counts, tops):
        return counts.join(tops, "o_custkey")

    return both.run(spark, max_workers=2)


# -- delegated: Spark's own operators inside nodes ---------------------------------------


def _through(spark, sf_dir, body, *names):
    """``body`` as a node over whole tables."""
    tables = [table(sf_dir, n) for n in names]

    @node(type="pyspark", dependencies=tables)
    def result(**frames):
        return body(*(frames[n] for n in names))

    return result.run(spark)


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def join_left(spark, sf_dir):
    return _through(spark, sf_dir, lambda c, o: c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey"), "customer", "orders")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey")
def join_inner(spark, sf_dir):
    return _through(spark, sf_dir, lambda o, c: o.join(c, F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "c_name"), "orders", "customer")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(spark, sf_dir):
    return _through(spark, sf_dir, lambda r, n: r.crossJoin(n).select("r_name", "n_name"), "region", "nation")


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_static_dim(spark, sf_dir):
    region = table(sf_dir, "region")

    @node(type="pyspark", dependencies=[table(sf_dir, "nation"), region.static()])
    def named(nation, region):
        return nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")

    return named.run(spark)


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def join_semi(spark, sf_dir):
    return _through(spark, sf_dir, lambda c, o: c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey"), "customer", "orders")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def join_anti(spark, sf_dir):
    urgent = F.col("o_orderpriority") == "1-URGENT"
    return _through(spark, sf_dir, lambda c, o: c.join(o.where(urgent), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey"), "customer", "orders")


@query("SELECT n_nationkey, s_suppkey FROM nation FULL JOIN supplier ON n_nationkey = s_nationkey")
def join_full(spark, sf_dir):
    return _through(spark, sf_dir, lambda n, s: n.join(s, F.col("n_nationkey") == F.col("s_nationkey"), "full").select("n_nationkey", "s_suppkey"), "nation", "supplier")


@query("SELECT event_type, CAST(SUM(CAST(value * 2 AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY event_type")
def agg_sum_expr(spark, sf_dir):
    return _through(spark, sf_dir, lambda e: e.groupBy("event_type").agg(F.sum((F.col("value") * 2).cast("decimal(18,2)")).cast("double").alias("total")), "events")


@query("SELECT user_id, event_type, MAX(ts) AS last_ts, COUNT(*) AS n FROM events GROUP BY user_id, event_type")
def agg_max_edge(spark, sf_dir):
    @node(type="spark_sql", dependencies=[table(sf_dir, "events")])
    def last(events):
        return f"SELECT user_id, event_type, MAX(ts) AS last_ts, COUNT(*) AS n FROM {events} GROUP BY user_id, event_type"

    return last.run(spark)


@query("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, COUNT(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def agg_rollup(spark, sf_dir):
    return _through(spark, sf_dir, lambda x: x.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.countDistinct("l_partkey").alias("parts")), "lineitem")


@query("""SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders""")
def window_rank(spark, sf_dir):
    over = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return _through(spark, sf_dir, lambda o: o.select("o_custkey", "o_orderkey", F.row_number().over(over).alias("place")), "orders")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def sort_top_k(spark, sf_dir):
    return _through(spark, sf_dir, lambda o: o.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100), "orders")


@query("SELECT event_id, event_type FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, event_type FROM events WHERE event_id % 2 = 1")
def union_nodes(spark, sf_dir):
    events = table(sf_dir, "events")

    @node(type="pyspark", dependencies=[events.preprocess(lambda df: df.where("event_id % 2 = 0")).select("event_id", "event_type")])
    def even(events):
        return events

    @node(type="pyspark", dependencies=[events.preprocess(lambda df: df.where("event_id % 2 = 1")).select("event_id", "event_type")])
    def odd(events):
        return events

    @node(type="pyspark", dependencies=[even, odd])
    def both(even, odd):
        return even.unionByName(odd)

    return both.run(spark)


@query("SELECT c_nationkey FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def set_except_all(spark, sf_dir):
    return _through(spark, sf_dir, lambda c, s: c.select("c_nationkey").exceptAll(s.select("s_nationkey")), "customer", "supplier")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, upper(event_type) AS kind FROM events")
def scalar_json(spark, sf_dir):
    return _through(spark, sf_dir, lambda e: e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.upper("event_type").alias("kind")), "events")


@query("SELECT n_nationkey, s_suppkey FROM nation RIGHT JOIN supplier ON n_nationkey = s_nationkey AND n_regionkey = 1")
def join_right(spark, sf_dir):
    on = (F.col("n_nationkey") == F.col("s_nationkey")) & (F.col("n_regionkey") == 1)
    return _through(spark, sf_dir, lambda n, s: n.join(s, on, "right").select("n_nationkey", "s_suppkey"), "nation", "supplier")


@query("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON s_acctbal BETWEEN c_acctbal - 25 AND c_acctbal + 25")
def join_range(spark, sf_dir):
    """Meets in bins as wide as the range, so that the join is by equality and neighbours are looked up."""
    bin_of = lambda c: F.floor(F.col(c) / 25)
    near = F.col("s_acctbal").between(F.col("c_acctbal") - 25, F.col("c_acctbal") + 25)

    def body(c, s):
        c = c.withColumn("bin", bin_of("c_acctbal"))
        s = s.withColumn("bin", F.explode(F.sequence(bin_of("s_acctbal") - 1, bin_of("s_acctbal") + 1)))
        return c.join(s, "bin").where(near).select("c_custkey", "s_suppkey")

    return _through(spark, sf_dir, body, "customer", "supplier")


@query("""SELECT p.event_id, c.ts AS click_ts FROM (SELECT * FROM events WHERE event_type = 'purchase') p
  ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts""")
def join_as_of(spark, sf_dir):
    """Each purchase with its user's last click: one shuffle and a running value, no pairs."""
    before = Window.partitionBy("user_id").orderBy("ts", "purchase").rowsBetween(Window.unboundedPreceding, 0)

    def body(e):
        e = e.where("event_type in ('purchase', 'click')").withColumn("purchase", F.col("event_type") == "purchase")
        e = e.withColumn("click_ts", F.last(F.when(~F.col("purchase"), F.col("ts")), ignorenulls=True).over(before))
        return e.where("purchase").select("event_id", "click_ts")

    return _through(spark, sf_dir, body, "events")


@query("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, MAX(l_quantity) AS top FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def agg_cube(spark, sf_dir):
    return _through(spark, sf_dir, lambda x: x.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.max("l_quantity").alias("top")), "lineitem")


@query("SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def agg_grouping_sets(spark, sf_dir):
    @node(type="spark_sql", dependencies=[table(sf_dir, "orders").select("o_orderstatus", "o_orderpriority")])
    def sets(orders):
        return f"SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())"

    return sets.run(spark)


@query("""SELECT o_orderpriority, COUNT(*) FILTER (o_orderstatus = 'F') AS F, COUNT(*) FILTER (o_orderstatus = 'O') AS O, COUNT(*) FILTER (o_orderstatus = 'P') AS P
  FROM orders GROUP BY o_orderpriority""")
def agg_pivot(spark, sf_dir):
    return _through(spark, sf_dir, lambda o: o.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0), "orders")


@query("SELECT event_type, COUNT(DISTINCT user_id) AS users, TRUE AS near FROM events GROUP BY event_type")
def agg_distinct(spark, sf_dir):
    """Exact, and whether the sketch of Spark is within a tenth of it."""
    near = F.abs(F.approx_count_distinct("user_id", 0.02) - F.countDistinct("user_id")) <= F.countDistinct("user_id") / 10
    return _through(spark, sf_dir, lambda e: e.groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), near.alias("near")), "events")


@query("""SELECT event_id, MAX(value) OVER w AS top, COUNT(*) OVER w AS n FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def window_frame(spark, sf_dir):
    over = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 0)
    return _through(spark, sf_dir, lambda e: e.select("event_id", F.max("value").over(over).alias("top"), F.count("*").over(over).alias("n")), "events")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 50 OFFSET 20")
def sort_offset(spark, sf_dir):
    return _through(spark, sf_dir, lambda o: o.select("o_orderkey").orderBy(F.desc("o_orderkey")).offset(20).limit(50), "orders")


@query("SELECT DISTINCT user_id, event_type FROM events")
def set_distinct(spark, sf_dir):
    return _through(spark, sf_dir, lambda e: e.select("user_id", "event_type").distinct(), "events")


@query("""SELECT p_partkey, CAST(regexp_extract(p_brand, '#([0-9]+)', 1) AS INTEGER) AS brand, regexp_replace(p_name, '[aeiou]', '', 'g') AS bare,
  CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS size, abs(p_size - 25) % 7 AS turn FROM part""")
def scalar_text(spark, sf_dir):
    size = F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "middle").otherwise("large")
    return _through(spark, sf_dir, lambda p: p.select("p_partkey", F.regexp_extract("p_brand", "#([0-9]+)", 1).cast("int").alias("brand"), F.regexp_replace("p_name", "[aeiou]", "").alias("bare"), size.alias("size"), (F.abs(F.col("p_size") - 25) % 7).alias("turn")), "part")


@query("""SELECT p_partkey, len(string_split(p_name, ' ')) AS n, array_to_string(list_sort(string_split(p_name, ' ')), '|') AS words, map([p_brand], [p_size])[p_brand] AS size FROM part""")
def scalar_nested(spark, sf_dir):
    words = F.split("p_name", " ")
    return _through(spark, sf_dir, lambda p: p.select("p_partkey", F.size(words).cast("long").alias("n"), F.array_join(F.array_sort(words), "|").alias("words"), F.create_map("p_brand", "p_size")[F.col("p_brand")].alias("size")), "part")


@query("SELECT o_orderkey, o_orderdate + INTERVAL 30 DAY AS due, year(o_orderdate) AS y FROM orders")
def scalar_interval(spark, sf_dir):
    return _through(spark, sf_dir, lambda o: o.select("o_orderkey", F.expr("o_orderdate + INTERVAL 30 DAY").alias("due"), F.year("o_orderdate").cast("long").alias("y")), "orders")


@query("SELECT p_partkey, CAST(p_size * 2 + 1 AS BIGINT) AS odd FROM part")
def udf_vectorised(spark, sf_dir):
    @F.pandas_udf("long")
    def odd(size: pd.Series) -> pd.Series:
        return size.astype("int64") * 2 + 1

    return _through(spark, sf_dir, lambda p: p.select("p_partkey", odd("p_size").alias("odd")), "part")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, COUNT(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark, sf_dir):
    """Event-time windows under a watermark, kept by a streaming query whose last state is read."""
    at = scratch(spark, "windows")
    spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", F.col("ts").cast("timestamp").alias("ts")).write.parquet(f"{at}/in")
    stream = file_stream(spark, f"{at}/in", "event_type string, ts timestamp", format="parquet")
    hours = stream.withWatermark("ts", "40 days").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    keep = lambda batch, k: batch.select(F.col("w.start").alias("hour"), "event_type", "n").write.mode("overwrite").parquet(f"{at}/out")
    hours.writeStream.outputMode("complete").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.parquet(f"{at}/out").withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("SELECT n_nationkey, n_name, n_regionkey, r_name FROM nation JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM region) USING (n_regionkey)")
def join_merge(spark, sf_dir):
    """pandas joins on the columns that both sides have."""
    regions = frame("regions", spark.read.parquet(f"{sf_dir}/region.parquet").withColumnRenamed("r_regionkey", "n_regionkey"))

    @node(type="pandas", dependencies=[table(sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), regions.select("n_regionkey", "r_name")])
    def merged(nation, regions):
        return nation.merge(regions)

    @node(type="pyspark", dependencies=[merged])
    def result(merged):
        return merged

    return result.run(spark)


@query("SELECT n_nationkey AS k, CASE WHEN n_regionkey > 0 THEN n_regionkey END AS region, CAST(NULL AS VARCHAR) AS note FROM nation")
def pandas_types(spark, sf_dir):
    """Declared types hold behind a pandas node: an integer with nulls, a column of nulls."""

    @node(type="pandas", dependencies=[table(sf_dir, "nation").select("n_nationkey", "n_regionkey")], output=Schema(Column("k", Integer()), Column("region", Integer()), Column("note", String())))
    def typed(nation):
        region = nation["n_regionkey"].where(nation["n_regionkey"] > 0)
        return nation.assign(k=nation["n_nationkey"], region=region, note=None)[["k", "region", "note"]]

    @node(type="pyspark", dependencies=[typed.select("k", "region", "note")])
    def result(typed):
        return typed

    return result.run(spark)


@query("SELECT r_regionkey, r_name FROM region")
def cache_table(spark, sf_dir):
    """A cache in the session's catalog; the second run reads it."""
    name = "regions_" + scratch(spark, "t").rsplit("-", 1)[1]

    @node(type="pyspark", dependencies=[table(sf_dir, "region")], cache=TableCache(name))
    def regions(region):
        return region

    regions.run(spark)
    return regions.run(spark)


# -- caches and changes ----------------------------------------------------------------------


def _balances(sf_dir, cache=None):
    @node(type="pyspark", dependencies=[table(sf_dir, "customer").select("c_custkey", "c_acctbal")], cache=cache)
    def balances(customer, least=0):
        return customer.where(F.col("c_acctbal") >= least)

    return balances


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 5000")
def cache_cold(spark, sf_dir):
    n = _balances(sf_dir, ParquetCache(scratch(spark, "cache")))
    return n.run(spark, parameters={n: {"least": 5000}})


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 0")
def cache_warm(spark, sf_dir):
    n = _balances(sf_dir, ParquetCache(scratch(spark, "cache")))
    n.run(spark, parameters={n: {"least": 0}})
    return n.run(spark, parameters={n: {"least": 5000}})


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 5000")
def cache_disable(spark, sf_dir):
    n = _balances(sf_dir, ParquetCache(scratch(spark, "cache")))
    n.run(spark, parameters={n: {"least": 0}})
    return n.run(spark, parameters={n: {"least": 5000}}, cache={n: CacheMode.DISABLE})


def _merged_orders(spark, sf_dir):
    """Orders merged twice, the second time with overlap and new prices; the node, its cache and the second result."""
    at = scratch(spark, "merge")
    cache = MergeCache(f"{at}/orders", ["o_orderkey"], f"{at}/ledger")
    orders = table(sf_dir, "orders")

    @node(type="pyspark", dependencies=[orders.select("o_orderkey", "o_totalprice")], cache=cache)
    def prices(orders):
        return orders

    base = spark.read.parquet(f"{sf_dir}/orders.parquet")
    prices.run(spark, inputs={orders: base.where("o_orderkey % 3 != 0")}, cache={prices: CacheMode.MERGE})
    new = base.where("o_orderkey % 2 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    return cache, prices.run(spark, inputs={orders: new}, cache={prices: CacheMode.MERGE})


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice
FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0""")
def merge_upsert(spark, sf_dir):
    return _merged_orders(spark, sf_dir)[0].table(spark).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0")
def merge_delta_result(spark, sf_dir):
    return _merged_orders(spark, sf_dir)[1].select("o_orderkey", "o_totalprice")


@query("SELECT event_id, value * 2 AS doubled FROM events WHERE event_id % 10 = 0")
def cdc_passthrough(spark, sf_dir):
    """Only rows that came to the first cache since the last run pass an uncached node into the last cache."""
    at = scratch(spark, "cdc")
    ledger = Ledger(f"{at}/ledger")
    base = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value")
    first = MergeCache(f"{at}/first", ["event_id"], ledger)

    @node(type="pyspark", dependencies=[table(sf_dir, "events")], cache=first)
    def raw(events):
        return events

    @node(type="pyspark", dependencies=[raw])
    def doubled(raw):
        return raw.select("event_id", (F.col("value") * 2).alias("doubled"))

    @node(type="pyspark", dependencies=[doubled], cache=MergeCache(f"{at}/last", ["event_id"], ledger))
    def last(doubled):
        return doubled

    first.write(spark, base.where("event_id % 10 != 0"))
    last.run(spark, cache={last: CacheMode.MERGE})
    first.write(spark, base.where("event_id % 10 = 0"))
    return last.run(spark, cache={last: CacheMode.MERGE}).select("event_id", "doubled")


@query("SELECT * FROM (VALUES ('c', 'b'), ('b', 'a')) t(source, destination)")
def cdc_ledger(spark, sf_dir):
    at = scratch(spark, "cdc")
    ledger = Ledger(f"{at}/ledger")
    made = {}
    up = table(sf_dir, "nation").select("n_nationkey", "n_name").alias("up")
    for name in "cba":
        made[name] = node(type="pyspark", dependencies=[up], cache=MergeCache(f"{at}/{name}", ["n_nationkey"], ledger), key=name, name=name)(lambda up: up)
        up = made[name].alias("up")
    made["a"].run(spark, cache=dict.fromkeys(made.values(), CacheMode.MERGE))
    return ledger.read(spark).select("source", "destination")


@query("SELECT o_orderkey, n_name FROM orders JOIN nation ON o_custkey % 25 = n_nationkey WHERE o_orderkey % 2 = 0")
def static_edge(spark, sf_dir):
    """The second run has new orders only, but the whole lookup."""
    at = scratch(spark, "cdc")
    ledger = Ledger(f"{at}/ledger")
    orders = table(sf_dir, "orders")

    @node(type="pyspark", dependencies=[table(sf_dir, "nation").select("n_nationkey", "n_name")], cache=MergeCache(f"{at}/lookup", ["n_nationkey"], ledger))
    def lookup(nation):
        return nation

    @node(type="pyspark", dependencies=[orders.select("o_orderkey", "o_custkey"), lookup.select("n_nationkey", "n_name").static()], cache=MergeCache(f"{at}/named", ["o_orderkey"], ledger))
    def named(orders, lookup):
        return orders.join(lookup, F.col("o_custkey") % 25 == F.col("n_nationkey")).select("o_orderkey", "n_name")

    base = spark.read.parquet(f"{sf_dir}/orders.parquet")
    modes = {named: CacheMode.MERGE}
    named.run(spark, inputs={orders: base.where("o_orderkey % 2 = 1")}, cache=modes)
    return named.run(spark, inputs={orders: base.where("o_orderkey % 2 = 0")}, cache=modes)


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def cdc_warm_skip(spark, sf_dir):
    """With both caches filled, what is above them never runs."""
    at = scratch(spark, "cdc")
    caches = [ParquetCache(f"{at}/{k}") for k in range(2)]

    @node(type="pyspark")
    def broken():
        raise RuntimeError("this must not run")

    @node(type="pyspark", dependencies=[broken], cache=caches[0])
    def names(broken):
        return broken

    @node(type="pyspark", dependencies=[broken], cache=caches[1])
    def balances(broken):
        return broken

    @node(type="pyspark", dependencies=[names, balances])
    def both(names, balances):
        return names.join(balances, "c_custkey")

    base = spark.read.parquet(f"{sf_dir}/customer.parquet")
    caches[0].write(spark, base.select("c_custkey", "c_name"))
    caches[1].write(spark, base.select("c_custkey", "c_acctbal"))
    return both.run(spark)


@query("SELECT event_type, COUNT(*) AS n, MAX(value) AS top FROM events GROUP BY event_type")
def stream_available_now(spark, sf_dir):
    """Events as a stream of JSON files, merged by key batch by batch."""
    at = scratch(spark, "stream")
    base = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "value")
    for k in range(2):
        base.where(F.col("event_id") % 2 == k).write.mode("append").json(f"{at}/in")
    arrivals = source("arrivals", lambda s: s.read.json(f"{at}/in"))
    cache = MergeCache(f"{at}/events", ["event_id"], f"{at}/ledger")

    @node(type="pyspark", dependencies=[arrivals], cache=cache)
    def merged(arrivals):
        return arrivals

    stream = file_stream(spark, f"{at}/in", "event_id long, event_type string, value double", maxFilesPerTrigger=8)
    run_stream(stream, merged, arrivals, f"{at}/checkpoint", cache={merged: CacheMode.MERGE}).awaitTermination()
    return cache.table(spark).groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("top"))


# -- documents about graphs -------------------------------------------------------------------


def _documented():
    @node(type="pyspark", key="nation", tags=["bronze"], description="Countries", output=Schema(Column("n_key", Integer(), "key", pk=True), Column("n_name", String(), "name")))
    def nation():
        return None

    @node(type="pyspark", key="customer", tags=["silver"], dependencies=[nation.select("n_key")], output=Schema(Column("c_key", Long(), pk=True), Column("c_nation", Integer()).many_to_one(nation.ref.n_key, "lives in")))
    def customer(nation):
        return None

    @node(type="pandas", key="report", tags=["gold"], dependencies=[customer, nation.select("n_key", "n_name").static()])
    def report(customer, nation):
        return None

    return report, customer


@query("""SELECT * FROM (VALUES ('nation', 'pyspark', 'Countries', 'bronze'), ('customer', 'pyspark', '', 'silver'), ('report', 'pandas', '', 'gold')) t(key, type, description, tag)""")
def lineage_nodes(spark, sf_dir):
    catalog = Catalog()
    catalog.register_node(_documented()[0])
    return catalog.nodes_frame(spark).select("key", "type", "description", F.col("tags")[0].alias("tag"))


@query("""SELECT * FROM (VALUES ('nation', 'customer', 'n_key', false), ('customer', 'report', '', false), ('nation', 'report', 'n_key,n_name', true)) t(source, destination, columns, static)""")
def lineage_edges(spark, sf_dir):
    catalog = Catalog()
    catalog.register_node(_documented()[0])
    return catalog.edges_frame(spark).withColumn("columns", F.array_join("columns", ","))


@query("""SELECT * FROM (VALUES ('Table customer {'), ('  c_key Long() [pk]'), ('  c_nation Integer()'), ('Table nation {'), ('  n_key Integer() [pk, note: ''''''key'''''']'), ('  n_name String() [note: ''''''name'''''']'), ('Ref lives in: customer.c_nation > nation.n_key')) t(line)""")
def dbml_text(spark, sf_dir):
    lines = build_dbml(_documented()[1]).splitlines()
    return spark.createDataFrame([(x,) for x in lines if x.startswith(("Table", "Ref", "  c_", "  n_"))], "line string")


@query("SELECT * FROM (VALUES (1, 'nation'), (2, 'customer'), (3, 'report')) t(depth, key)")
def graph_depth(spark, sf_dir):
    depths = Plan(_documented()[0]).depths()
    return spark.createDataFrame([(d, k) for d, keys in depths.items() for k in keys], "depth int, key string")


@query("SELECT n_nationkey AS k, upper(n_name) AS name FROM nation")
def frame_source(spark, sf_dir):
    """A pandas frame as a source."""
    held = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name").toPandas()

    @node(type="spark_sql", dependencies=[frame("held", held)])
    def named(held):
        return f"SELECT n_nationkey AS k, upper(n_name) AS name FROM {held}"

    return named.run(spark)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
