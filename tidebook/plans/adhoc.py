"""The ad-hoc SQL surface: what the query shell reaches, over the driver's tables, with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebook.plans.market import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_CENTS = "CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT)"


def _cents(c: str = "l_extendedprice"):
    return F.sum(F.round(F.col(c) * 100).cast("long"))


@query(f"""SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sum_qty, {_CENTS} AS sum_cents, count(*) AS n, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("long")).alias("sum_qty"), _cents().alias("sum_cents"), F.count(F.lit(1)).alias("n"), F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"))


@query("SELECT r_name, n_name, count(*) AS customers FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def join_inner(spark, sf_dir):
    # region and nation hold fixed lists of at most some hundred rows
    places = table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return places.join(c, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name", "n_name").agg(F.sum("n").alias("customers"))


@query(f"""SELECT c_mktsegment, o_orderpriority, {_CENTS} AS cents, count(DISTINCT o_orderkey) AS orders FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY ALL""")
def join_three_way(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")).select("o_orderkey", "o_custkey", "o_orderpriority")
    per_order = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(_cents().alias("cents"))
    j = o.join(per_order, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("c_custkey") == F.col("o_custkey"))
    return j.groupBy("c_mktsegment", "o_orderpriority").agg(F.sum("cents").alias("cents"), F.count(F.lit(1)).alias("orders"))


@query("SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def join_left(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    return table(spark, sf_dir, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0).cast("long")).alias("orders"))


@query("SELECT s_suppkey, c_custkey, coalesce(s_nationkey, c_nationkey) AS nation FROM (SELECT * FROM supplier WHERE s_suppkey % 2 = 0) FULL JOIN (SELECT * FROM customer WHERE c_custkey % 3 = 0) ON s_suppkey = c_custkey")
def join_full(spark, sf_dir):
    s, c = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0"), table(spark, sf_dir, "customer").where("c_custkey % 3 = 0")
    return s.join(c, F.col("s_suppkey") == F.col("c_custkey"), "full").select("s_suppkey", "c_custkey", F.coalesce("s_nationkey", "c_nationkey").alias("nation"))


@query("SELECT p_partkey, s_suppkey FROM supplier RIGHT JOIN part ON s_suppkey = p_partkey AND s_acctbal > 0")
def join_right(spark, sf_dir):
    return table(spark, sf_dir, "supplier").where("s_acctbal > 0").join(table(spark, sf_dir, "part"), F.col("s_suppkey") == F.col("p_partkey"), "right").select("p_partkey", "s_suppkey")


@query("SELECT r_name, x.kind FROM region CROSS JOIN (SELECT DISTINCT event_type AS kind FROM events) x")
def join_cross(spark, sf_dir):
    # two fixed lists, each row of one for each of the other; the kinds, told from the data, are counted first
    kinds = table(spark, sf_dir, "events").agg(F.collect_set("event_type").alias("kinds"), F.count_distinct("event_type").alias("n"))
    kinds = kinds.select(F.when(F.col("n") <= 1_000, F.col("kinds")).otherwise(F.raise_error(F.lit("too many kinds for a cross join"))).alias("kinds"))
    return table(spark, sf_dir, "region").select("r_name").join(F.broadcast(kinds), F.lit(True)).select("r_name", F.explode("kinds").alias("kind"))


@query("SELECT c_custkey, c_acctbal FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def join_semi(spark, sf_dir):
    big = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(big, "c_custkey", "left_semi").select("c_custkey", "c_acctbal")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def join_anti(spark, sf_dir):
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(done, "c_custkey", "left_anti").select("c_custkey")


@query("SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_theta(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    a, b = n.select("n_regionkey", F.col("n_nationkey").alias("a"), F.col("n_name").alias("a_name")), n.select("n_regionkey", F.col("n_nationkey").alias("b"), F.col("n_name").alias("b_name"))
    return a.join(b, "n_regionkey").where("a < b").select("a_name", "b_name")


@query("SELECT o_custkey AS k FROM orders INTERSECT SELECT l_suppkey FROM lineitem")
def set_intersect(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).intersect(table(spark, sf_dir, "lineitem").select("l_suppkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_except(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, sf_dir, "orders").select("o_custkey"))


@query("SELECT o_custkey % 50 AS k FROM orders EXCEPT ALL SELECT c_custkey % 50 FROM customer")
def set_except_all(spark, sf_dir):
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("k")).exceptAll(table(spark, sf_dir, "customer").select(F.col("c_custkey") % 50))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union_distinct(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("SELECT DISTINCT l_shipdate::DATE AS day, l_returnflag FROM lineitem")
def distinct_days(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("day"), "l_returnflag").distinct()


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def group_rollup(spark, sf_dir):
    return table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_brand, p_size % 5 AS size5, count(*) AS n, grouping_id(p_brand, p_size % 5) AS gid FROM part GROUP BY CUBE (p_brand, p_size % 5)")
def group_cube(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", (F.col("p_size") % 5).alias("size5"))
    return p.cube("p_brand", "size5").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid"))


@query("SELECT event_type, hour(ts) AS hour, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (hour(ts)), ())")
def group_sets(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.hour("ts").cast("long").alias("hour"))
    return e.groupingSets([[F.col("event_type")], [F.col("hour")], []], "event_type", "hour").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 600 OR sum(CAST(l_quantity AS BIGINT)) % 7 = 0")
def group_having(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("q"))
    return g.where("n > 600 OR q % 7 = 0").select("l_suppkey", "n")


@query("SELECT event_id, user_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS BIGINT) AS cents4, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS next_type, ntile(4) OVER (PARTITION BY user_id ORDER BY event_id) AS quarter FROM events")
def window_frames(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy("event_id")
    cents = F.round(F.col("value") * 100).cast("long")
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.sum(cents).over(w.rowsBetween(-3, 0)).alias("cents4"), F.lead("event_type").over(w).alias("next_type"), F.ntile(4).over(w).cast("long").alias("quarter"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def top_three_per_key(spark, sf_dir):
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice").withColumn("rn", F.row_number().over(w)).where("rn <= 3").drop("rn")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT p_partkey FROM part p WHERE p_retailprice > (SELECT avg(q.p_retailprice) + 100 FROM part q WHERE q.p_brand = p.p_brand)")
def correlated_subquery(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return spark.sql("SELECT p_partkey FROM {p} p WHERE p_retailprice > (SELECT avg(q.p_retailprice) + 100 FROM {p} q WHERE q.p_brand = p.p_brand)", p=p)


@query("WITH o AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), m AS (SELECT max(n) AS most FROM o) SELECT o_custkey, n FROM o WHERE n >= (SELECT most FROM m) - 2")
def cte_scalar_subquery(spark, sf_dir):
    return spark.sql("WITH o AS (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey), m AS (SELECT max(n) AS most FROM o) SELECT o_custkey, n FROM o WHERE n >= (SELECT most FROM m) - 2", orders=table(spark, sf_dir, "orders"))


@query("SELECT c_mktsegment, median(c_acctbal) AS med, quantile_cont(c_acctbal, 0.9) AS p90 FROM customer GROUP BY c_mktsegment")
def medians(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.median("c_acctbal").alias("med"), F.percentile("c_acctbal", 0.9).alias("p90"))


@query(None)
def approx_distinct(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"))


@query("SELECT o_orderstatus, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (NOT o_orderpriority = '1-URGENT') AS others FROM orders GROUP BY o_orderstatus")
def filtered_aggregates(spark, sf_dir):
    return spark.sql("SELECT o_orderstatus, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (WHERE NOT o_orderpriority = '1-URGENT') AS others FROM {orders} GROUP BY o_orderstatus", orders=table(spark, sf_dir, "orders"))


@query("SELECT s_nationkey, string_agg(s_suppkey, '|' ORDER BY s_suppkey) AS suppliers, len(list(s_suppkey)) AS n FROM supplier GROUP BY s_nationkey")
def list_functions(spark, sf_dir):
    g = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.sort_array(F.collect_list("s_suppkey")).alias("l"))
    return g.select("s_nationkey", F.array_join(F.transform("l", lambda x: x.cast("string")), "|").alias("suppliers"), F.size("l").cast("long").alias("n"))


@query("SELECT o_orderpriority, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS f, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS o, sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END)::BIGINT AS p FROM orders GROUP BY o_orderpriority")
def pivot_status(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return g.select("o_orderpriority", *[F.coalesce(k, F.lit(0).cast("long")).alias(k.lower()) for k in "FOP"])


@query("SELECT conv_id, count(*) AS turns, count(DISTINCT role) AS roles, CAST(sum(length(text)) AS BIGINT) AS chars, arg_min(role, turn) AS first_role FROM conversations GROUP BY conv_id")
def conversation_summary(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.countDistinct("role").alias("roles"), F.sum(F.length("text")).cast("long").alias("chars"), F.min_by("role", "turn").alias("first_role"))
