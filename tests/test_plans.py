import pytest
from pyspark.sql import functions as F

from twosight.operators import joins, reshape
from twosight.plans import decisions, fairness, impact, mapping, overview, performance, preparation, timeuse
from twosight.sources import SCHEMAS, read_csv, read_tsv

PREDICTIONS = SCHEMAS["predictions"]


def predictions(spark, rows):
    """Rows of (id, index, order, part, setting, condition, h, hr, r, bh, bhr, br, th, thr, outcome)."""
    return spark.createDataFrame(rows, PREDICTIONS)


@pytest.fixture(scope="module")
def pred(spark):
    na, an = "No anchor", "Anchor"
    return predictions(
        spark,
        [
            (1, 10, 2, 1, na, "None", 0.4, None, 0.6, 0, None, 1, 5.0, None, 0),
            (1, 11, 17, 2, na, "None", 0.2, 0.5, 0.8, 0, 1, 1, 6.0, 3.0, 1),
            (1, 12, 18, 2, na, "None", 0.5, 0.5, 0.55, 1, 1, 1, 4.0, 2.0, 1),
            (1, 13, 19, 2, na, "None", 0.7, 0.7, 0.7, 1, 1, 1, 4.0, 2.0, 0),
            (2, 10, 2, 1, an, "Decreasing", 0.9, None, 0.6, 1, None, 1, 9.0, None, 0),
            (2, 11, 17, 2, an, "Decreasing", None, 1.0, 0.8, None, 1, 1, None, 12.0, 1),
        ],
    )


def test_readers(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,survey_time,mturk_time,bonus\n1,60,NA,3.5\n2,120,180,4.0\n")
    rows = read_csv(spark, str(tmp_path / "t.csv"), "time_payment").orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, 60, None, 3.5), (2, 120, 180, 4.0)]
    (tmp_path / "m.csv").write_text("ogs\tprs\tmean_qb\n1\t0\t0.25\n1\tRFEL\t0.5\n")
    assert [tuple(r) for r in read_tsv(spark, str(tmp_path / "m.csv"), "model_matrix").collect()] == [(1, "0", 0.25), (1, "RFEL", 0.5)]


def test_long_has_one_row_per_given_answer(pred):
    long = preparation.assessments_long(pred)
    assert {r.type: r["count"] for r in long.groupBy("type").count().collect()} == {"h": 5, "hr": 4}
    row = long.where("id = 1 AND index = 11 AND type = 'hr'").first()
    assert (row.qp, row.qb, row.time, row.qp_r) == (0.5, 1, 3.0, 0.8)


def test_everyone_keeps_pairs_together(pred):
    rows = preparation.everyone_long(pred).where("type = 'r'")
    assert rows.count() == 6 and rows.where("qp > 0.5 AND qb = 1").count() == 6


def test_influence_needs_a_gap(spark):
    df = spark.createDataFrame([(0.5, 0.6, 0.5), (0.25, 0.28, 0.3125), (0.2, 0.5, 0.8)], "qp_h double, qp_hr double, qp_r double")
    open_, closed = (
        [r[0] for r in df.select(impact.influence(min_gap=0.0625, closed=c)).collect()] for c in (False, True)
    )
    assert open_ == [None, None, pytest.approx(0.5)]
    assert closed == [None, pytest.approx(0.48), pytest.approx(0.5)]


def test_influence_missing_answer(spark):
    df = spark.createDataFrame([(None, 0.5, 0.9)], "qp_h double, qp_hr double, qp_r double")
    assert df.select(impact.influence()).first()[0] is None


def test_perception_rules(spark):
    names = [c.split()[0] for c in SCHEMAS["perception"].split(", ")]
    row = dict.fromkeys(names) | {
        "id": 1, "humanaccuracy_1": "7/14", "humanaccuracy_2": "13/25", "humanaccuracy_3": "3/0", "use_binary_2": "abc",
        "confidence_1": "Extremely confident", "humanaccuracy_comparison_3": "approximately equal to the median accuracy (41-60%)", "trust_3": "Yes",
    }
    df = spark.createDataFrame([tuple(row[n] for n in names)], SCHEMAS["perception"])
    got = {r.set_q: r for r in preparation.perception_long(df).collect()}
    assert (got[1].humanaccuracy, got[2].humanaccuracy, got[3].humanaccuracy) == (0.5, None, None)
    assert (got[1].confidence, got[2].confidence) == ("Confident", "Somewhat confident")
    assert (got[1].humanaccuracy_comparison, got[3].humanaccuracy_comparison) == ("Higher", "Median")
    assert (got[1].trust, got[2].use_binary, got[3].trust) == (None, None, "Yes")


def test_beat_model_counts_ties(pred):
    everyone = preparation.everyone_long(pred)
    got = performance.beat_model(performance.with_matched_model(everyone)).first()
    assert (got.participants, got.n_r, got.share_r) == (2, 2, 1.0)


def test_accuracy_sets(pred):
    got = {(r.id, r.set_q): r.acc for r in performance.accuracy_by_set(preparation.everyone_long(pred), before=19).collect()}
    assert got == {(1, 1): 1.0, (1, 2): 1.0, (1, 3): pytest.approx(2 / 3), (2, 1): 0.0, (2, 2): 1.0, (2, 3): 1.0}


def test_behaviour_counts(pred):
    got = impact.behaviour_counts(preparation.part_two(pred, "No anchor"), near=0.1).first()
    assert tuple(got) == (0, 0, 1, 1)


def test_revisions(pred):
    got = impact.revision_stats(preparation.part_two(pred, "No anchor")).first()
    assert (got.n_revised, got.revised, got.switch_when_disagree, got.acc_qb_hr) == (1, pytest.approx(1 / 3), 1.0, 1.0)
    assert sum(r.prop for r in impact.revision_matrix(preparation.part_two(pred, "No anchor")).where("qb_h = 1").collect()) == pytest.approx(100)


def test_item_influence_needs_both_types(spark):
    rows = [("h", 0.2), ("h", 0.4), ("h", 0.3), ("hr", 0.5), ("hr", 0.5), ("hr", 0.5)]
    data = [(1, "x", t, q, 0.7) for t, q in rows] + [(2, "x", t, q, 0.7) for t, q in rows[:5]]
    df = spark.createDataFrame(data, "index int, grp string, type string, qp double, qp_r double")
    got = fairness.item_influence(df, "grp").collect()
    assert [r["index"] for r in got] == [1] and got[0].influence == pytest.approx(0.5)


def test_bands_share_rows(spark):
    df = spark.createDataFrame([(0.4, 1), (0.45, 0), (0.5, 1), (0.6, 1), (0.61, 0), (0.1, 0)], "qp double, qb int")
    got = {r.band: (r.n, r.mean_qb) for r in mapping.bands(df).collect()}
    assert got == {
        "below half": (3, pytest.approx(1 / 3)), "above half": (2, 0.5), "40 to half": (2, 0.5), "half": (1, 1.0), "half to 60": (1, 1.0),
    }


def test_top_scores_close_the_last_decile(spark):
    df = spark.createDataFrame([(1.0, 1), (0.99, 0), (0.9, 1), (0.0, 0)], "qp double, qb int")
    assert {r.qp_binned: r.n for r in mapping.decile_curve(df).collect()} == {0.9: 3, 0.0: 1}


def test_time_of_a_participant_with_one_item(spark):
    df = spark.createDataFrame([(1, 9.0, 1), (2, 4.0, 1), (2, 6.0, 2)], "id int, time double, k int")
    got = timeuse.by_time_within_participant(df, ["k"], keep=())
    assert sorted((r.id, r.n, round(r.time_cum, 6)) for r in got.collect()) == [(1, 1, 1.0), (2, 1, 0.6), (2, 2, 1.0)]
    assert timeuse.decrease_by_participant(got, top=1).count() == 1


def test_slow_answers(pred):
    assert preparation.drop_fast(pred, 5.0).count() == 4


def test_pay_and_gaps(spark):
    df = spark.createDataFrame([(1, 3600, 3700, 3.5), (2, 1800, None, 2.5), (3, 0, 1300, 1.0)], SCHEMAS["time_payment"])
    pay = [r[0] for r in df.select(overview.hourly_pay("bonus", "survey_time")).collect()]
    assert pay == [5.0, 8.0, None]
    within = {(r.minutes, r.within): r.n for r in overview.gap_within(df, (5, 30)).collect()}
    assert within == {(5, True): 1, (5, False): 1, (30, True): 2}


def test_decision_matrix_and_actors(spark, pred):
    items = spark.createDataFrame(
        [(10, None, 1, "y", "c"), (11, "2", 3, None, "c"), (12, "5", 11, "y", "d"), (13, "2", 3, None, "d")],
        SCHEMAS["items_full"],
    )
    rows = decisions.with_items(pred, decisions.recode_items(items))
    model = spark.createDataFrame([(3, "2", 0.5), (12, "0", 0.1)], SCHEMAS["model_matrix"])
    judges = spark.createDataFrame([(3, "2", 0.25)], SCHEMAS["judge_matrix"])
    got = {(r.type, r.ogs, r.prs): r.mean_qb for r in decisions.decision_matrix(rows, model, judges).collect()}
    # The two answers to item 11 (no, yes), item 11's anchored answer (yes), and item 13 (yes, yes).
    assert got == {
        ("Participants", 1, "RFEL"): 0.5, ("Participants", 3, "2"): 0.8, ("RAI", 3, "2"): 0.5, ("Judges", 3, "2"): 0.25,
    }
    assert decisions.incarceration_rate(rows).first()[0] == 0.5
    reg = decisions.regression_rows(rows)
    assert {r.prs for r in reg.select("prs").distinct().collect()} == {6.0, 2.0, 5.0}
    table = {r.crimecat: r.n for r in decisions.charge_table(reg).collect()}
    assert table == {"c": 2, "d": 2}


def test_joins(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y"), (3, "z")], "k int, a string")
    b = spark.createDataFrame([(1, "p"), (None, "q")], "k int, b string")
    assert joins.join_on(a, b, "k").count() == 1
    assert sorted(r.b for r in joins.join_on(a, b, "k", null_safe=True).collect()) == ["p", "q"]
    assert joins.natural_join(a, b).columns == ["k", "a", "b"]
    assert joins.keep_matching(a, b, "k").count() == 1 and joins.keep_unmatched(a, b, "k").count() == 2


def test_reshape(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "id int, x_1 double, x_2 double")
    assert reshape.strip_from_names(reshape.select_matching(df, "_1$", ["id"]), "_1").columns == ["x", "id"]
    long = reshape.longer(df, ["id"], ["x_1", "x_2"])
    wide = reshape.wider(long, ["id"], "type", ["x_2", "x_1"], "value").first()
    assert (wide.x_1, wide.x_2) == (2.0, 3.0)
    both = reshape.append(df, df.select("id")).orderBy(F.col("x_1").asc_nulls_last()).collect()
    assert both[1].x_1 is None
