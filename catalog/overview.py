from pyspark.sql import functions as F

from catalog.registry import query
from catalog.views import assess, view
from twosight.operators import layers, reshape, summary
from twosight.plans import overview, preparation


@query(
    "study_sizes",
    """SELECT count(DISTINCT id) AS participants, count(DISTINCT idx) AS items,
       count(qp_hr) + count(qp_h) AS score_answers, count(qb_hr) + count(qb_h) AS binary_answers FROM assess""",
)
def _(spark, d):
    return overview.sizes(assess(spark, d))


@query(
    "time_and_pay",
    """WITH v AS (SELECT 'minutes' AS variable, survey_time / 60.0::DOUBLE AS x FROM times
       UNION ALL SELECT 'bonus', bonus FROM times
       UNION ALL SELECT 'salary', (bonus + 1.5::DOUBLE) * 3600 / survey_time FROM times)
       SELECT variable, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd, round(median(x), 6) AS median
       FROM v GROUP BY variable""",
    ["times"],
)
def _(spark, d):
    return overview.time_and_pay(view(spark, d, "times")).select("variable", "mean", "sd", "median")


@query(
    "time_per_answer",
    """WITH v AS (SELECT time_h AS x FROM assess WHERE time_h IS NOT NULL
       UNION ALL SELECT time_hr FROM assess WHERE time_hr IS NOT NULL)
       SELECT count(*) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd, round(median(x), 6) AS median,
       round(min(x), 6) AS min, round(max(x), 6) AS max FROM v""",
)
def _(spark, d):
    return overview.time_per_answer(assess(spark, d)).select("n", "mean", "sd", "median", "min", "max")


@query(
    "total_time_by_setting",
    """WITH v AS (SELECT setting, id, time_h AS x FROM assess WHERE time_h IS NOT NULL
       UNION ALL SELECT setting, id, time_hr FROM assess WHERE time_hr IS NOT NULL),
       p AS (SELECT setting, id, sum(x) / 60 AS total FROM v GROUP BY setting, id)
       SELECT setting, count(*) AS n, round(avg(total), 6) AS mean, round(stddev_samp(total), 6) AS sd,
       round(median(total), 6) AS median FROM p GROUP BY setting""",
)
def _(spark, d):
    return overview.total_time(assess(spark, d)).select("setting", "n", "mean", "sd", "median")


@query(
    "age_bands",
    """WITH b AS (SELECT CASE WHEN age < 18 THEN '<18' WHEN age <= 24 THEN '18-24' WHEN age <= 34 THEN '25-34'
       WHEN age <= 59 THEN '35-59' WHEN age <= 78 THEN '60-78' ELSE '79+' END AS age_band FROM demographics)
       SELECT age_band, count(*) AS n, round_even(count(*) / (SELECT count(*) FROM b), 2) AS prop FROM b GROUP BY age_band""",
    ["demographics"],
)
def _(spark, d):
    return overview.age_table(view(spark, d, "demographics"))


@query(
    "age_summary",
    "SELECT count(*) AS n, round(avg(age), 6) AS mean, round(stddev_samp(age), 6) AS sd, round(median(age), 6) AS median FROM demographics",
    ["demographics"],
)
def _(spark, d):
    return overview.age_summary(view(spark, d, "demographics")).select("n", "mean", "sd", "median")


for _column in ("gender", "race", "ml_familiarity"):

    @query(
        f"share_of_{_column}",
        f"""SELECT {_column}, count(*) AS n, round_even(count(*) / (SELECT count(*) FROM demographics), 2) AS prop
        FROM demographics GROUP BY {_column}""",
        ["demographics"],
    )
    def _(spark, d, column=_column):
        return overview.category_table(view(spark, d, "demographics"), column)


@query(
    "share_of_education_25_plus",
    """WITH p AS (SELECT * FROM demographics WHERE age >= 25)
       SELECT education, count(*) AS n, round_even(count(*) / (SELECT count(*) FROM p), 2) AS prop FROM p GROUP BY education""",
    ["demographics"],
)
def _(spark, d):
    return overview.category_table(view(spark, d, "demographics"), "education", min_age=25)


@query(
    "degree_share",
    """WITH p AS (SELECT CASE WHEN regexp_matches(coalesce(education, ''), 'Associate|Bachelor|Graduate') THEN 1 ELSE 0 END AS x
       FROM demographics WHERE age >= 25)
       SELECT round(avg(x), 6) AS mean, CAST(sum(x) AS BIGINT) AS n, count(*) AS total FROM p""",
    ["demographics"],
)
def _(spark, d):
    return overview.degree_share(view(spark, d, "demographics"))


@query(
    "region_counts",
    """SELECT CASE WHEN location IN ('Maine', 'New York') THEN 'northeast' WHEN location IN ('Ohio', 'Iowa', 'Kansas') THEN 'midwest'
       WHEN location IN ('California', 'Utah', 'Alaska', 'Hawaii') THEN 'west' ELSE 'other' END AS region, count(*) AS n
       FROM demographics GROUP BY 1""",
    ["demographics"],
)
def _(spark, d):
    return overview.region_counts(view(spark, d, "demographics"))


@query(
    "locations_outside_list",
    """SELECT DISTINCT location FROM demographics
       WHERE NOT coalesce(location IN ('Maine', 'Ohio', 'California', 'New York', 'Utah', 'Iowa'), false)""",
    ["demographics"],
)
def _(spark, d):
    listed = ["Maine", "Ohio", "California", "New York", "Utah", "Iowa"]
    return overview.other_locations(view(spark, d, "demographics"), listed)


@query(
    "participants_per_setting",
    """WITH p AS (SELECT DISTINCT id, setting FROM assess)
       SELECT setting, count(*) AS n, round_even(count(*) / (SELECT count(*) FROM p), 3) AS prop FROM p GROUP BY setting""",
)
def _(spark, d):
    return overview.participants_per_arm(assess(spark, d), ["setting"])


@query(
    "participants_within_setting",
    """WITH p AS (SELECT DISTINCT id, setting, condition FROM assess),
       c AS (SELECT setting, condition, count(*) AS n FROM p GROUP BY setting, condition)
       SELECT setting, condition, n, round_even(n / sum(n) OVER (PARTITION BY setting), 3) AS prop FROM c""",
)
def _(spark, d):
    return overview.participants_per_arm(assess(spark, d), ["setting", "condition"], ["setting"])


@query(
    "base_rate_of_used_items",
    "SELECT round_even(avg(y), 3) AS base_rate FROM items WHERE idx IN (SELECT idx FROM assess)",
    ["assess", "items"],
)
def _(spark, d):
    return overview.base_rate(preparation.used_items(view(spark, d, "items"), assess(spark, d)))


@query(
    "prediction_summary",
    """WITH s AS (SELECT 'human score' AS source, qp FROM long UNION ALL SELECT 'model score', qp_r FROM assess)
       SELECT source, round(avg(qp), 6) AS mean, round(median(qp), 6) AS median FROM s GROUP BY source
       UNION ALL SELECT 'human binary', round(avg(qb), 6), NULL FROM long
       UNION ALL SELECT 'model binary', round(avg(CASE WHEN qp_r > 0.5 THEN 1 ELSE 0 END), 6), NULL FROM assess""",
    ["long"],
)
def _(spark, d):
    return overview.prediction_summary(assess(spark, d))


@query(
    "session_times",
    """SELECT round(avg(survey_time / 60.0::DOUBLE), 6) AS mean_survey, round(avg(mturk_time / 60.0::DOUBLE), 6) AS mean_task,
       round(stddev_samp(survey_time / 60.0::DOUBLE), 6) AS sd_survey, round(stddev_samp(mturk_time / 60.0::DOUBLE), 6) AS sd_task,
       round(avg(mturk_time::DOUBLE / survey_time), 6) AS ratio_per_participant,
       round(avg(mturk_time / 60.0::DOUBLE) / avg(CASE WHEN mturk_time IS NOT NULL THEN survey_time / 60.0::DOUBLE END), 6) AS ratio_all,
       round(median(survey_time / 60.0::DOUBLE), 6) AS median_survey, round(median(mturk_time / 60.0::DOUBLE), 6) AS median_task FROM times""",
    ["times"],
)
def _(spark, d):
    return overview.session_times(view(spark, d, "times"))


@query(
    "gap_within_minutes",
    """WITH g AS (SELECT m AS minutes, abs(mturk_time / 60.0::DOUBLE - survey_time / 60.0::DOUBLE) < m AS within
       FROM times, (VALUES (5), (10), (20)) t(m) WHERE mturk_time IS NOT NULL),
       c AS (SELECT minutes, within, count(*) AS n FROM g GROUP BY minutes, within)
       SELECT minutes, within, n, round_even(n / sum(n) OVER (PARTITION BY minutes), 3) AS prop FROM c""",
    ["times"],
)
def _(spark, d):
    return overview.gap_within(view(spark, d, "times"))


@query(
    "times_inside_limits",
    """SELECT id, round(survey_time / 60.0::DOUBLE, 6) AS survey, round(mturk_time / 60.0::DOUBLE, 6) AS task FROM times
       WHERE survey_time / 60.0::DOUBLE BETWEEN 0 AND 45 AND mturk_time / 60.0::DOUBLE BETWEEN 0 AND 45""",
    ["times"],
)
def _(spark, d):
    return overview.both_times_frame(view(spark, d, "times"), (0.0, 45.0))


@query(
    "age_histogram",
    """WITH s AS (SELECT min(age)::DOUBLE AS lo, (max(age) - min(age))::DOUBLE / 29.0::DOUBLE AS w FROM demographics),
       b AS (SELECT CAST(ceil((age - lo) / w - 0.5::DOUBLE) AS BIGINT) AS bin, lo, w FROM demographics, s)
       SELECT bin, round(lo + bin * w, 6) AS center, count(*) AS n FROM b GROUP BY bin, lo, w""",
    ["demographics"],
)
def _(spark, d):
    return layers.histogram(view(spark, d, "demographics"), "age")


@query(
    "answers_given_by_column",
    """SELECT count(qp_h) AS qp_h, count(qp_hr) AS qp_hr, count(qb_h) AS qb_h, count(qb_hr) AS qb_hr,
       count(qp_h) + count(qp_hr) + count(qb_h) + count(qb_hr) AS total FROM assess""",
)
def _(spark, d):
    return reshape.positives_by_name(assess(spark, d), ["qp_h", "qp_hr", "qb_h", "qb_hr"])


@query(
    "strict_and_lenient_means",
    """SELECT setting, CASE WHEN count(time_h) = count(*) THEN round(avg(time_h), 6) END AS strict_mean,
       round(avg(time_h), 6) AS known_mean, count(*) AS n FROM assess GROUP BY setting""",
)
def _(spark, d):
    from twosight.functions.nulls import strict

    return assess(spark, d).groupBy("setting").agg(
        strict(F.avg("time_h"), "time_h").alias("strict_mean"), F.avg("time_h").alias("known_mean"), F.count(F.lit(1)).alias("n")
    )


@query(
    "label_coverage",
    """SELECT quality, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 6) AS prop
       FROM documents LEFT JOIN labels USING (doc_id) GROUP BY quality""",
    [],
)
def _(spark, d):
    from twosight.sources import read_parquet

    docs = read_parquet(spark, d, "documents", ["doc_id"])
    labels = read_parquet(spark, d, "labels", ["doc_id", "quality"])
    return summary.share(docs.join(labels, "doc_id", "left"), ["quality"])
