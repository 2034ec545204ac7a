from pyspark.sql import functions as F

from catalog import sqltext as q
from catalog.layers import density_sql
from catalog.registry import off_ties, query
from catalog.views import assess, view
from twosight.functions.nulls import flag
from twosight.operators import inference, layers, ranks
from twosight.operators.summary import keep_groups
from twosight.plans import preparation, timeuse

# Columns that make an answer of a participant unique.
_TIES = ["type", "k1", "order_question", "index", "k2"]
_SQL_TIES = "type, k1, order_question, idx, k2"
_KEEP = [
    "id", "index", "order_question", "survey_part", "setting", "condition", "outcome", "k1", "k2",
]
_CUM = (
    f"cum AS (SELECT id, survey_part, time, row_number() OVER w AS n, sum(time) OVER (w ROWS UNBOUNDED PRECEDING) / sum(time) OVER (PARTITION BY id) AS time_cum "
    f"FROM long WHERE setting = 'Anchor' WINDOW w AS (PARTITION BY id ORDER BY time DESC, {_SQL_TIES}))"
)
_TP = "tp AS (SELECT * FROM long WHERE NOT (survey_part = 2 AND setting = 'No anchor'))"
_RIGHT = "CASE WHEN qb = outcome THEN 1 ELSE 0 END"


def _long(spark, d):
    return preparation.assessments_long(assess(spark, d), keep=_KEEP)


def _anchor(spark, d):
    return _long(spark, d).where("setting = 'Anchor'")


def _cum(spark, d):
    return timeuse.by_time_within_participant(_anchor(spark, d), _TIES)


def _tp(spark, d):
    return _long(spark, d).where(timeuse.not_second_look())


@query(
    "item_times",
    """WITH s AS (SELECT 'all' AS subset, time FROM long UNION ALL SELECT 'single look', time FROM long WHERE NOT (survey_part = 2 AND setting = 'No anchor')
       UNION ALL SELECT 'second look', time FROM long WHERE survey_part = 2 AND setting = 'No anchor' AND type = 'hr')
       SELECT subset, count(*) AS n, round(avg(time), 6) AS mean, round(stddev_samp(time), 6) AS sd, round(median(time), 6) AS median FROM s GROUP BY subset""",
    ["long"],
)
def _(spark, d):
    return timeuse.item_times(_long(spark, d)).select("subset", "n", "mean", "sd", "median")


@query(
    "time_concentration",
    f"""WITH {_CUM}, t AS (SELECT 1 AS top, time_cum FROM cum WHERE n <= 1 UNION ALL SELECT 4, time_cum FROM cum WHERE n <= 4)
        SELECT top, round(avg(time_cum), 6) AS value, round(stddev_samp(time_cum), 6) AS sd, round(median(time_cum), 6) AS median, count(*) AS n FROM t GROUP BY top""",
    ["long"],
)
def _(spark, d):
    return timeuse.top_share(timeuse.slowest(_anchor(spark, d), _TIES))


@query(
    "cumulative_time_rows",
    f"WITH {_CUM} SELECT id, n, round(time, 6) AS time, round(time_cum, 6) AS time_cum FROM cum",
    ["long"],
)
def _(spark, d):
    return _cum(spark, d).select("id", "n", "time", "time_cum")


@query(
    "time_without_top",
    f"WITH {_CUM} SELECT round(avg(time), 6) AS value, round(stddev_samp(time), 6) AS sd, round(stddev_samp(time) / sqrt(count(*)), 6) AS se, count(*) AS n FROM cum WHERE n > 4",
    ["long"],
)
def _(spark, d):
    return timeuse.without_slowest(_anchor(spark, d), _TIES)


_DEC = (
    f"{_CUM}, dc AS (SELECT id, avg(time) AS mt, avg(CASE WHEN n > 4 THEN time END) AS ms FROM cum GROUP BY id HAVING count(CASE WHEN n > 4 THEN 1 END) > 0)"
)


@query(
    "time_decrease",
    f"WITH {_DEC} SELECT round(1 - avg(ms / mt), 6) AS mean_time_decrease, round(stddev_samp(ms / mt), 6) AS sd, count(*) AS n FROM dc",
    ["long"],
)
def _(spark, d):
    return timeuse.mean_decrease(timeuse.decrease_without_slowest(_anchor(spark, d), _TIES))


@query(
    "time_decrease_by_participant",
    f"WITH {_DEC} SELECT id, round(mt + 1e-9, 6) AS mean_time, round(ms + 1e-9, 6) AS mean_time_sub, round(mt / ms, 6) AS decrease FROM dc",
    ["long"],
)
def _(spark, d):
    return off_ties(timeuse.decrease_without_slowest(_anchor(spark, d), _TIES), "mean_time", "mean_time_sub")


@query(
    "time_decrease_histogram",
    f"""WITH {_DEC}, x AS (SELECT round(mt / ms, 6) AS x FROM dc), s AS (SELECT min(x) AS lo, (max(x) - min(x)) / 29.0::DOUBLE AS w FROM x)
        SELECT CAST(ceil((x - lo) / w - 0.5::DOUBLE) AS BIGINT) AS bin, round(lo + ceil((x - lo) / w - 0.5::DOUBLE) * w, 6) AS center, count(*) AS n FROM x, s GROUP BY 1, 2""",
    ["long"],
)
def _(spark, d):
    return layers.histogram(timeuse.decrease_without_slowest(_anchor(spark, d), _TIES), F.round("decrease", 6))


@query(
    "first_item",
    """SELECT order_question = 2 AS first_item, round(avg(time), 6) AS mean_time, round(median(time), 6) AS median_time,
       round(stddev_samp(time) / sqrt(count(*)), 6) AS se_time FROM long WHERE survey_part = 1 GROUP BY 1""",
    ["long"],
)
def _(spark, d):
    return timeuse.first_item(_long(spark, d).where("survey_part = 1"), 2)


@query(
    "first_item_rank_sum",
    q.rank_sum_sql("SELECT time AS x, CASE WHEN order_question = 2 THEN 0 ELSE 1 END AS a FROM long WHERE survey_part = 1"),
    ["long"],
)
def _(spark, d):
    return timeuse.first_item_test(_long(spark, d).where("survey_part = 1"), 2)


@query(
    "first_item_rank_sum_part2",
    q.rank_sum_sql("SELECT time AS x, CASE WHEN order_question = 3 THEN 0 ELSE 1 END AS a FROM long WHERE survey_part = 2"),
    ["long"],
)
def _(spark, d):
    return timeuse.first_item_test(_long(spark, d).where("survey_part = 2"), 3)


@query(
    "first_item_part_two",
    f"""WITH {_TP} SELECT order_question = 3 AS first_item, round(avg(time), 6) AS mean_time, round(median(time), 6) AS median_time,
        round(stddev_samp(time) / sqrt(count(*)), 6) AS se_time FROM tp GROUP BY 1""",
    ["long"],
)
def _(spark, d):
    return timeuse.first_item(_tp(spark, d), 3)


@query(
    "time_by_part",
    """WITH p AS (SELECT id, survey_part, sum(time) AS t FROM long WHERE setting = 'Anchor' GROUP BY id, survey_part),
       s AS (SELECT survey_part, t / sum(t) OVER (PARTITION BY id) AS x FROM p)
       SELECT survey_part, round(avg(x), 6) AS mean_time_part, round(median(x), 6) AS median_time_part, round(stddev_samp(x), 6) AS sd FROM s GROUP BY survey_part""",
    ["long"],
)
def _(spark, d):
    return timeuse.time_by_part(_anchor(spark, d))


@query(
    "spearman_time_acc",
    f"WITH {_TP}, act AS (SELECT id, avg({_RIGHT}) AS acc, round(sum(time) / 60, 6) AS tt FROM tp WHERE setting = 'Anchor' GROUP BY id), "
    + q.spearman_sql("SELECT acc AS x, tt AS y FROM act")[5:],
    ["long"],
)
def _(spark, d):
    at = timeuse.accuracy_and_time(_tp(spark, d).where("setting = 'Anchor'"))
    return ranks.spearman(at, "acc", F.round("total_time", 6))


@query(
    "time_by_correct",
    f"WITH {_TP} SELECT qb = outcome AS correct, round(avg(time), 6) AS mean_time, round(median(time), 6) AS median_time, count(*) AS n FROM tp GROUP BY 1",
    ["long"],
)
def _(spark, d):
    return timeuse.time_by_correct(_tp(spark, d))


@query(
    "welch_time_by_correct",
    f"WITH {_TP}, " + q.welch_sql("SELECT CASE WHEN qb = outcome THEN time END AS xa, CASE WHEN qb <> outcome THEN time END AS xb FROM tp")[5:],
    ["long"],
)
def _(spark, d):
    return inference.welch_t(_tp(spark, d), "time", flag(F.col("qb") == F.col("outcome")), 1, 0)


@query(
    "rank_sum_time_by_correct",
    f"WITH {_TP}, " + q.rank_sum_sql(f"SELECT time AS x, {_RIGHT} AS a FROM tp")[5:],
    ["long"],
)
def _(spark, d):
    return ranks.rank_sum(_tp(spark, d), "time", flag(F.col("qb") == F.col("outcome")), 1, 0)


@query(
    "rank_by_correct",
    f"""WITH {_TP}, r AS (SELECT {_RIGHT} AS correct, row_number() OVER (PARTITION BY id ORDER BY time, {_SQL_TIES}) AS rank FROM tp)
        SELECT correct, round(avg(rank), 6) AS mean_rank, round(median(rank), 6) AS median_rank, count(*) AS n FROM r GROUP BY correct""",
    ["long"],
)
def _(spark, d):
    return timeuse.rank_by_correct(_tp(spark, d), _TIES)


_DESC = "dl AS (SELECT l.*, length(description) AS n_char, floor(length(description) / 50)::BIGINT AS n_char_bin FROM long l JOIN descriptions USING (idx) WHERE setting = 'Anchor')"


def _desc(spark, d):
    return timeuse.with_text_length(_anchor(spark, d), view(spark, d, "descriptions"))


@query(
    "density_time_by_length",
    f"WITH {_DESC}, big AS (SELECT n_char_bin FROM dl GROUP BY n_char_bin HAVING count(*) > 200), "
    + density_sql("SELECT n_char_bin AS g, time AS x FROM dl JOIN big USING (n_char_bin)", 0, 60)[5:]
    + "SELECT g AS n_char_bin, point::BIGINT AS point, round(xg, 6) AS x, round(density, 6) AS density, round(bw, 6) AS bw, n FROM k",
    ["long", "descriptions"],
)
def _(spark, d):
    many = keep_groups(_desc(spark, d), ["n_char_bin"], F.count(F.lit(1)) > 200)
    return layers.density(many, "time", ["n_char_bin"], limits=(0.0, 60.0))


@query("spearman_time_length", f"WITH {_DESC}, " + q.spearman_sql("SELECT time AS x, n_char AS y FROM dl")[5:], ["long", "descriptions"])
def _(spark, d):
    return ranks.spearman(_desc(spark, d), "time", "n_char")


@query(
    "length_effect",
    f"WITH {_DESC}, "
    + q.rank_sum_sql(
        f"SELECT 'outcome' AS split, n_char AS x, 1 - outcome AS a FROM dl UNION ALL SELECT 'correct', n_char, 1 - {_RIGHT} FROM dl", ["split"]
    )[5:],
    ["long", "descriptions"],
)
def _(spark, d):
    both = F.array(
        F.struct(F.lit("outcome").alias("split"), F.col("outcome").alias("g")),
        F.struct(F.lit("correct").alias("split"), flag(F.col("qb") == F.col("outcome")).alias("g")),
    )
    rows = _desc(spark, d).select("n_char", F.inline(both))
    return ranks.rank_sum(rows, "n_char", "g", 0, 1, ["split"])


@query(
    "time_by_length_bin",
    f"WITH {_DESC} SELECT n_char_bin, count(*) AS n, round(avg(time), 6) AS mean, round(median(time), 6) AS median FROM dl GROUP BY n_char_bin HAVING count(*) > 50",
    ["long", "descriptions"],
)
def _(spark, d):
    return timeuse.time_by_length(_desc(spark, d), more_than=50)


@query(
    "rows_of_large_length_bins",
    f"""WITH {_DESC}, k AS (SELECT *, count(*) OVER (PARTITION BY n_char_bin) AS c FROM dl)
        SELECT type, count(*) AS n, count(DISTINCT n_char_bin) AS bins FROM k WHERE c > 50 GROUP BY type""",
    ["long", "descriptions"],
)
def _(spark, d):
    rows = timeuse.rows_of_large_bins(_desc(spark, d), more_than=50)
    return rows.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("n_char_bin").alias("bins"))


@query(
    "sampled_participant_boxes",
    """WITH ids AS (SELECT DISTINCT id FROM long WHERE setting = 'Anchor'),
       c AS (SELECT id FROM ids ORDER BY (id % 2147483647) * 48271 % 2147483647, id LIMIT 100),
       x AS (SELECT id, time FROM long WHERE setting = 'Anchor' AND id IN (SELECT id FROM c)),
       m AS (SELECT id, median(time) AS md FROM x GROUP BY id), o AS (SELECT id, row_number() OVER (ORDER BY round(md, 9), id) AS ord FROM m),
       s AS (SELECT id, count(*) AS n, quantile_cont(time, 0.25) AS q1, median(time) AS md, quantile_cont(time, 0.75) AS q3 FROM x WHERE time BETWEEN 0 AND 60 GROUP BY id)
       SELECT id, n, round(q1 + 1e-9, 6) AS q1, round(md + 1e-9, 6) AS median, round(q3 + 1e-9, 6) AS q3, ord FROM s JOIN o USING (id)""",
    ["long"],
)
def _(spark, d):
    place = (F.col("id") % 2147483647) * 48271 % 2147483647
    boxes = timeuse.participant_boxes(_anchor(spark, d), 100, place)
    return off_ties(boxes.select("id", "n", "q1", "median", "q3", "ord"), "q1", "median", "q3")
