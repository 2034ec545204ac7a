from pyspark.sql import functions as F

from catalog.registry import query
from catalog.views import assess
from twosight.functions.nulls import bin_floor
from twosight.operators import layers, ordered
from twosight.operators.reshape import longer
from twosight.operators.summary import describe
from twosight.plans import impact, preparation
from twosight.sources import read_parquet


def density_sql(source: str, low: float, high: float, points: int = 512, fine: int = 1024) -> str:
    """Density of ``source`` (g, x) on a grid from low to high, on linearly binned values."""
    return (
        f"WITH src AS ({source}), x AS (SELECT g, x::DOUBLE AS x FROM src WHERE x BETWEEN {low}::DOUBLE AND {high}::DOUBLE), "
        "b AS (SELECT g, 0.9::DOUBLE * least(stddev_samp(x), (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.34::DOUBLE) * pow(count(*), -0.2::DOUBLE) AS bw, count(*) AS n FROM x GROUP BY g), "
        f"p AS (SELECT g, (x - {low}::DOUBLE) / ({high}::DOUBLE - {low}::DOUBLE) * {fine - 1} AS pos FROM x), "
        f"s AS (SELECT g, pos, least(floor(pos), {fine - 2}) AS l FROM p), "
        "w AS (SELECT g, l AS node, 1 - (pos - l) AS w FROM s UNION ALL SELECT g, l + 1, pos - l FROM s), "
        "nd AS (SELECT g, node, sum(w) AS w FROM w GROUP BY g, node), "
        f"gr AS (SELECT i AS point, {low}::DOUBLE + i * ({high}::DOUBLE - {low}::DOUBLE) / {points - 1} AS xg FROM range({points}) t(i)), "
        f"k AS (SELECT g, point, xg, bw, n, sum(w * exp(-0.5::DOUBLE * pow((xg - ({low}::DOUBLE + node * ({high}::DOUBLE - {low}::DOUBLE) / {fine - 1})) / bw, 2))) / (n * bw * sqrt(2 * pi())) AS density "
        "FROM nd JOIN b USING (g), gr GROUP BY g, point, xg, bw, n) "
    )


@query(
    "histogram_event_value",
    """WITH s AS (SELECT event_type, min(value) AS lo, (max(value) - min(value)) / 29.0::DOUBLE AS w FROM events GROUP BY event_type),
       b AS (SELECT event_type, CAST(ceil((value - lo) / w - 0.5::DOUBLE) AS BIGINT) AS bin, lo, w FROM events JOIN s USING (event_type))
       SELECT event_type, bin, round(lo + bin * w, 6) AS center, count(*) AS n FROM b GROUP BY event_type, bin, lo, w""",
    [],
)
def _(spark, d):
    return layers.histogram(read_parquet(spark, d, "events", ["event_type", "value"]), "value", ["event_type"])


@query(
    "density_grid",
    density_sql("SELECT qb = outcome AS g, time AS x FROM long WHERE type = 'hr'", 0, 60)
    + "SELECT g AS correct, point::BIGINT AS point, round(xg, 6) AS x, round(density, 6) AS density, round(bw, 6) AS bw, n FROM k",
    ["long"],
)
def _(spark, d):
    rows = preparation.assisted(assess(spark, d)).withColumn("correct", F.col("qb") == F.col("outcome"))
    return layers.density(rows, "time", ["correct"], limits=(0.0, 60.0))


@query(
    "density_before_after",
    density_sql(
        "SELECT 'initial_diff' AS g, round(abs(qp_h - qp_r), 6) AS x FROM na UNION ALL SELECT 'final_diff', round(abs(qp_hr - qp_r), 6) FROM na", 0, 1
    )
    + "SELECT g AS type, point::BIGINT AS point, round(xg, 6) AS x, round(density, 6) AS density, round(bw, 6) AS bw, n FROM k",
    ["na"],
)
def _(spark, d):
    rows = impact.before_after(preparation.part_two(assess(spark, d), "No anchor"))
    return layers.density(rows, F.round("value", 6), ["type"], limits=(0.0, 1.0))


@query(
    "density_influence_by_participant",
    density_sql(
        """SELECT 1 AS g, round(avg(CASE WHEN abs(qp_h - qp_r) > 0.05::DOUBLE THEN (qp_hr - qp_h) / (qp_r - qp_h) END), 6) AS x FROM na GROUP BY id""", -0.5, 1
    )
    + "SELECT point::BIGINT AS point, round(xg, 6) AS x, round(density, 6) AS density, round(bw, 6) AS bw, n FROM k",
    ["na"],
)
def _(spark, d):
    pair = impact.with_influence(preparation.part_two(assess(spark, d), "No anchor"))
    people = pair.groupBy("id").agg(F.round(F.avg("influence"), 6).alias("mean_influence"))
    return layers.density(people, "mean_influence", limits=(-0.5, 1.0))


def ridges_sql(source: str, group: str) -> str:
    """Ridges of ``source`` (qp_r_bin, <group>, x) with one bandwidth, padded by three of them beyond 0 and 1."""
    return f"""WITH x AS (SELECT * FROM ({source}) z WHERE x BETWEEN 0 AND 1),
       b AS (SELECT qp_r_bin, {group}, 0.9::DOUBLE * least(stddev_samp(x), (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.34::DOUBLE) * pow(count(*), -0.2::DOUBLE) AS bw,
             count(*) AS n FROM x GROUP BY 1, 2 HAVING count(*) >= 3),
       s AS (SELECT avg(bw) AS bw, 0 - 3 * avg(bw) AS lo, 1 + 3 * avg(bw) AS hi FROM b),
       p AS (SELECT qp_r_bin, {group}, n, (x - lo) / (hi - lo) * 1023 AS pos FROM x JOIN b USING (qp_r_bin, {group}), s),
       w AS (SELECT qp_r_bin, {group}, n, least(floor(pos), 1022) AS node, 1 - (pos - least(floor(pos), 1022)) AS w FROM p
             UNION ALL SELECT qp_r_bin, {group}, n, least(floor(pos), 1022) + 1, pos - least(floor(pos), 1022) FROM p),
       nd AS (SELECT qp_r_bin, {group}, n, node, sum(w) AS w FROM w GROUP BY 1, 2, 3, 4),
       k AS (SELECT qp_r_bin, {group}, i AS point, lo + i * (hi - lo) / 511 AS x, bw, n,
             sum(w * exp(-0.5::DOUBLE * pow((i * (hi - lo) / 511 - node * (hi - lo) / 1023) / bw, 2))) / (n * bw * sqrt(2 * pi())) AS density
             FROM nd, s, range(512) t(i) GROUP BY qp_r_bin, {group}, i, lo, hi, bw, n)
       SELECT qp_r_bin, {group}, point, round(x, 6) AS x, round(density, 6) AS density, round(bw, 6) AS bw, n FROM k"""


@query("density_ridges", ridges_sql("SELECT floor(qp_r * 10) / 10 AS qp_r_bin, setting, qp AS x FROM long WHERE type = 'hr'", "setting"), ["long"])
def _(spark, d):
    rows = preparation.assisted(assess(spark, d)).withColumn("qp_r_bin", bin_floor("qp_r", 10))
    return layers.ridges(rows, "qp", ["qp_r_bin", "setting"], limits=(0.0, 1.0))


@query(
    "density_ridges_before_after",
    ridges_sql(
        "SELECT floor(qp_r * 10) / 10 AS qp_r_bin, 'qp_h' AS type, qp_h AS x FROM na UNION ALL SELECT floor(qp_r * 10) / 10, 'qp_hr', qp_hr FROM na", "type"
    ),
    ["na"],
)
def _(spark, d):
    pair = preparation.part_two(assess(spark, d), "No anchor").withColumn("qp_r_bin", bin_floor("qp_r", 10))
    return layers.ridges(longer(pair, ["qp_r_bin"], ["qp_h", "qp_hr"], "type", "value"), "value", ["qp_r_bin", "type"], limits=(0.0, 1.0))


@query(
    "box_stats",
    """WITH s AS (SELECT event_type, count(*) AS n, quantile_cont(value, 0.25) AS q1, median(value) AS md, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY event_type),
       k AS (SELECT *, value BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1) AS ok FROM events JOIN s USING (event_type))
       SELECT event_type, n, round(q1, 6) AS q1, round(md, 6) AS median, round(q3, 6) AS q3, round(min(CASE WHEN ok THEN value END), 6) AS ymin,
       round(max(CASE WHEN ok THEN value END), 6) AS ymax, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS outliers,
       round(md - 1.58::DOUBLE * (q3 - q1) / sqrt(n), 6) AS notch_lower, round(md + 1.58::DOUBLE * (q3 - q1) / sqrt(n), 6) AS notch_upper
       FROM k GROUP BY event_type, n, q1, md, q3""",
    [],
)
def _(spark, d):
    return layers.box_stats(read_parquet(spark, d, "events", ["event_type", "value"]), "value", ["event_type"])


@query(
    "quantile_interval",
    """SELECT event_type, round(quantile_cont(value, 0.025), 6) AS lb, round(quantile_cont(value, 0.975), 6) AS ub FROM events GROUP BY event_type""",
    [],
)
def _(spark, d):
    events = read_parquet(spark, d, "events", ["event_type", "value"])
    return ordered.quantiles(events, "value", {"lb": 0.025, "ub": 0.975}, ["event_type"])


@query(
    "describe_with_missing",
    """WITH v AS (SELECT lang, CASE WHEN quality = 1 THEN n_chars END AS x FROM documents LEFT JOIN labels USING (doc_id))
       SELECT lang, count(x) AS n, count(*) AS n_rows, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd, round(stddev_samp(x) / sqrt(count(*)), 6) AS se,
       round(median(x), 6) AS median, min(x)::DOUBLE AS min, max(x)::DOUBLE AS max FROM v GROUP BY lang""",
    [],
)
def _(spark, d):
    docs = read_parquet(spark, d, "documents", ["doc_id", "lang", "n_chars"])
    labels = read_parquet(spark, d, "labels", ["doc_id", "quality"])
    joined = docs.join(labels, "doc_id", "left")
    return describe(joined, F.when(F.col("quality") == 1, F.col("n_chars")), ["lang"])


@query(
    "sampled_groups",
    """WITH c AS (SELECT DISTINCT user_id FROM events), k AS (SELECT user_id FROM c ORDER BY (user_id % 2147483647) * 48271 % 2147483647, user_id LIMIT 20)
       SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE user_id IN (SELECT user_id FROM k) GROUP BY user_id""",
    [],
    digits=4,
)
def _(spark, d):
    events = read_parquet(spark, d, "events", ["user_id", "value"])
    chosen = ordered.sample_groups(events, "user_id", 20, (F.col("user_id") % 2147483647) * 48271 % 2147483647)
    return chosen.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
