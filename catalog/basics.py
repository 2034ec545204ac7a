"""Joins, reshaping, unions and per-group selection on the raw tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog.registry import query
from twosight.functions.nulls import char_length, row_min
from twosight.operators import joins, reshape, summary
from twosight.sources import read_parquet


@query(
    "join_natural",
    """WITH s AS (SELECT c_nationkey, avg(c_acctbal) AS mean_bal, count(*) AS n FROM customer GROUP BY c_nationkey)
       SELECT c_custkey, c_nationkey, round(c_acctbal - mean_bal, 6) AS gap, n FROM customer JOIN s USING (c_nationkey)""",
    [],
)
def _(spark, d):
    rows = read_parquet(spark, d, "customer", ["c_custkey", "c_nationkey", "c_acctbal"])
    stat = rows.groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("mean_bal"), F.count(F.lit(1)).alias("n"))
    out = joins.natural_join(rows, stat)
    return out.select("c_custkey", "c_nationkey", (F.col("c_acctbal") - F.col("mean_bal")).alias("gap"), "n")


@query("join_semi", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')", [])
def _(spark, d):
    urgent = read_parquet(spark, d, "orders", ["o_custkey", "o_orderpriority"]).where("o_orderpriority = '1-URGENT'")
    people = read_parquet(spark, d, "customer", ["c_custkey", "c_mktsegment"])
    return joins.keep_matching(people, urgent.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query("join_anti", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')", [])
def _(spark, d):
    urgent = read_parquet(spark, d, "orders", ["o_custkey", "o_orderpriority"]).where("o_orderpriority = '1-URGENT'")
    people = read_parquet(spark, d, "customer", ["c_custkey", "c_mktsegment"])
    return joins.keep_unmatched(people, urgent.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query(
    "join_missing_keys",
    """WITH x AS (SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id)), s AS (SELECT quality, count(*) AS n FROM x GROUP BY quality)
       SELECT x.doc_id, x.quality, s.n FROM x JOIN s ON x.quality IS NOT DISTINCT FROM s.quality""",
    [],
)
def _(spark, d):
    docs = read_parquet(spark, d, "documents", ["doc_id"])
    rows = docs.join(read_parquet(spark, d, "labels", ["doc_id", "quality"]), "doc_id", "left")
    return joins.join_on(rows, rows.groupBy("quality").agg(F.count(F.lit(1)).alias("n")), "quality", null_safe=True)


@query(
    "append_rows",
    """SELECT s_suppkey AS key, s_acctbal AS balance, NULL AS segment FROM supplier
       UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment FROM customer""",
    [],
)
def _(spark, d):
    a = read_parquet(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))
    b = read_parquet(spark, d, "customer")
    return reshape.append(a, b.select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")))


@query("distinct_rows", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer", [])
def _(spark, d):
    return read_parquet(spark, d, "customer", ["c_nationkey", "c_mktsegment"]).distinct()


@query("set_difference", "SELECT p_partkey AS key FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 49", [])
def _(spark, d):
    sold = read_parquet(spark, d, "lineitem", ["l_partkey", "l_quantity"]).where("l_quantity > 49")
    return read_parquet(spark, d, "part").select(F.col("p_partkey").alias("key")).subtract(sold.select("l_partkey"))


@query(
    "longer_rows",
    "SELECT l_returnflag, 'l_discount' AS type, count(*) AS n, round(sum(l_discount), 4) AS total FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, 'l_tax', count(*), round(sum(l_tax), 4) FROM lineitem GROUP BY 1",
    [],
    digits=4,
)
def _(spark, d):
    lines = read_parquet(spark, d, "lineitem", ["l_returnflag", "l_discount", "l_tax"])
    long = reshape.longer(lines, ["l_returnflag"], ["l_discount", "l_tax"])
    return long.groupBy("l_returnflag", "type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query(
    "wider_rows",
    """SELECT c_nationkey, max(CASE WHEN c_mktsegment = 'BUILDING' THEN n END) AS "BUILDING", max(CASE WHEN c_mktsegment = 'FURNITURE' THEN n END) AS "FURNITURE"
       FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2) c GROUP BY c_nationkey""",
    [],
)
def _(spark, d):
    counts = read_parquet(spark, d, "customer", ["c_nationkey", "c_mktsegment"]).groupBy("c_nationkey", "c_mktsegment").agg(
        F.count(F.lit(1)).alias("n")
    )
    return reshape.wider(counts, ["c_nationkey"], "c_mktsegment", ["BUILDING", "FURNITURE"], "n")


@query(
    "largest_per_group",
    """WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders)
       SELECT o_custkey, o_orderkey, o_totalprice, n FROM r WHERE n <= 2""",
    [],
)
def _(spark, d):
    orders = read_parquet(spark, d, "orders", ["o_custkey", "o_orderkey", "o_totalprice"])
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey"))
    return orders.withColumn("n", place).where("n <= 2").withColumn("n", F.col("n").cast("long"))


@query(
    "small_cells_left_out",
    "SELECT l_suppkey, l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1, 2 HAVING count(*) > 200",
    [],
)
def _(spark, d):
    lines = read_parquet(spark, d, "lineitem", ["l_suppkey", "l_returnflag", "l_quantity"])
    cells = lines.groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("mean"))
    return cells.where("n > 200")


@query(
    "ratios",
    """SELECT l_linestatus, round(avg(l_extendedprice) / avg(l_quantity), 6) AS of_means, round(avg(l_extendedprice / l_quantity), 6) AS of_rows FROM lineitem GROUP BY l_linestatus""",
    [],
)
def _(spark, d):
    lines = read_parquet(spark, d, "lineitem", ["l_linestatus", "l_extendedprice", "l_quantity"])
    price, amount = F.col("l_extendedprice"), F.col("l_quantity")
    return lines.groupBy("l_linestatus").agg(
        summary.ratio_of_means(price, amount).alias("of_means"), summary.mean_of_ratios(price, amount).alias("of_rows")
    )


@query(
    "text_length_bins",
    """SELECT lang, CAST(floor(length(text) / 500) AS BIGINT) AS bin, count(*) AS n, CAST(sum(CASE WHEN length(text) = n_chars THEN 1 ELSE 0 END) AS BIGINT) AS agree
       FROM documents GROUP BY 1, 2""",
    [],
)
def _(spark, d):
    docs = read_parquet(spark, d, "documents", ["lang", "text", "n_chars"]).withColumn("len", char_length("text"))
    return docs.groupBy("lang", F.floor(F.col("len") / 500).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("len") == F.col("n_chars")).cast("int")).alias("agree")
    )


@query(
    "row_minimum",
    """SELECT lang, round(avg(CASE WHEN quality IS NULL THEN NULL ELSE least(n_chars / 1000.0::DOUBLE, quality) END), 6) AS mean
       FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""",
    [],
)
def _(spark, d):
    docs = read_parquet(spark, d, "documents", ["doc_id", "lang", "n_chars"])
    rows = docs.join(read_parquet(spark, d, "labels", ["doc_id", "quality"]), "doc_id", "left")
    least = row_min(F.col("n_chars") / 1000, F.col("quality").cast("double"))
    return rows.groupBy("lang").agg(F.avg(least).alias("mean"))
