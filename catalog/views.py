"""Study-shaped views of the test tables.

Both engines build a view from the same column expressions, so a query and its SQL text start
from identical rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from twosight.sources import read_parquet

_BASE = {
    "id": "o_custkey",
    "idx": "l_partkey",
    "order_question": "l_linenumber",
    "survey_part": "CASE WHEN l_linenumber <= 2 THEN 1 ELSE 2 END",
    "setting": "CASE WHEN o_custkey % 2 = 0 THEN 'Anchor' ELSE 'No anchor' END",
    "condition": "CASE WHEN o_custkey % 3 = 0 THEN 'None' WHEN o_custkey % 3 = 1 THEN 'Controlled' ELSE 'Decreasing' END",
    "grp": "CASE WHEN l_partkey % 2 = 0 THEN 'g0' ELSE 'g1' END",
    "outcome": "CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END",
    "rf": "l_returnflag",
    "qp_r": "round(l_discount * 10, 6)",
    "qp0": "round(l_quantity / 50, 6)",
    "w": "round(l_tax * 12.5, 6)",
    "t0": "l_extendedprice / 1000",
    "k1": "l_orderkey",
    "k2": "l_suppkey",
}
_SCORED = {
    "qp_h": "CASE WHEN survey_part = 1 OR setting = 'No anchor' THEN qp0 END",
    "qp_hr": "CASE WHEN survey_part = 2 THEN round(qp0 + (qp_r - qp0) * w, 6) END",
}
_ANSWER = "CASE WHEN {q} IS NULL THEN NULL WHEN rf = 'R' THEN 1 WHEN rf = 'A' THEN 0 WHEN {q} > 0.5 THEN 1 ELSE 0 END"
_ASSESS = {
    **{c: c for c in ("id", "idx", "order_question", "survey_part", "setting", "condition", "grp", "outcome")},
    "qp_h": "qp_h",
    "qp_hr": "qp_hr",
    "qp_r": "qp_r",
    "qb_h": _ANSWER.format(q="qp_h"),
    "qb_hr": _ANSWER.format(q="qp_hr"),
    "qb_r": "CASE WHEN qp_r > 0.5 THEN 1 ELSE 0 END",
    "time_h": "CASE WHEN qp_h IS NOT NULL THEN t0 END",
    "time_hr": "CASE WHEN qp_hr IS NOT NULL THEN t0 END",
    "k1": "k1",
    "k2": "k2",
}

_LEVELS = ["Not confident at all", "Slightly confident", "Somewhat confident", "Moderately confident", "Extremely confident"]
_RANKS = [
    "among the lowest accuracies (0-20%)",
    "lower than most accuracies (21-40%)",
    "approximately equal to the median accuracy (41-60%)",
    "higher than most accuracies (61-80%)",
    "among the highest accuracies (81-100%)",
]


def _choice(key: str, texts: list[str]) -> str:
    """One of the texts by ``key``; NULL for any other value of it."""
    return "CASE " + key + "".join(f" WHEN {i} THEN '{t}'" for i, t in enumerate(texts)) + " END"


def _out_of(top: str, n: int) -> str:
    return f"concat(CAST({top} % {n + 1} AS STRING), '/{n}')"


_PERCEPTION = {
    "id": "c_custkey",
    "humanaccuracy_1": f"CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN 'abc' ELSE {_out_of('c_custkey', 14)} END",
    "humanaccuracy_2": f"CASE WHEN c_custkey % 7 = 0 THEN {_out_of('c_custkey', 25)} ELSE {_out_of('c_custkey * 5', 14)} END",
    "humanaccuracy_3": _out_of("c_custkey * 7", 25),
    "use_binary_2": _out_of("c_custkey * 3", 14),
    "use_binary_3": _out_of("c_custkey * 5", 25),
    "use_likelihood_2": f"CASE WHEN c_custkey % 17 = 0 THEN '3/0' ELSE {_out_of('c_custkey * 11', 14)} END",
    "use_likelihood_3": _out_of("c_custkey * 3 + c_nationkey", 25),
    "confidence_1": _choice("c_nationkey % 5", _LEVELS),
    "confidence_2": _choice("c_custkey % 6", _LEVELS),
    "confidence_3": _choice("(c_custkey + c_nationkey) % 7", _LEVELS),
    "humanaccuracy_comparison_1": _choice("c_custkey % 5", _RANKS),
    "humanaccuracy_comparison_2": _choice("(c_custkey + c_nationkey) % 6", _RANKS),
    "humanaccuracy_comparison_3": _choice("c_nationkey % 7", _RANKS),
    "trust_2": "CASE WHEN c_acctbal > 3000 THEN 'Yes' ELSE 'No' END",
    "trust_3": "CASE WHEN c_acctbal > 4000 THEN 'Yes' ELSE 'No' END",
}
_DEMOGRAPHICS = {
    "id": "c_custkey",
    "age": "15 + CAST(c_custkey % 68 AS INT)",
    "gender": _choice("c_custkey % 5", ["Male", "Female", "Male", "Female"]),
    "race": _choice("c_nationkey % 4", ["White", "Black", "Asian", "White"]),
    "education": _choice(
        "c_nationkey % 7",
        ["Associate degree", "Bachelor degree", "Graduate degree", "High school", "Some college", "Less than high school"],
    ),
    "location": _choice(
        "c_nationkey % 13",
        ["Maine", "Ohio", "Texas", "California", "New York", "Florida", "Utah", "Iowa", "Alaska", "Georgia", "Hawaii", "Kansas"],
    ),
    "ml_familiarity": "CASE WHEN c_acctbal > 2000 THEN 'Yes' ELSE 'No' END",
}
_TIMES = {
    "id": "o_orderkey",
    "survey_time": "60 + CAST(floor(o_totalprice / 100) AS INT)",
    "mturk_time": "CASE WHEN o_orderkey % 16 = 0 THEN NULL ELSE 60 + CAST(floor(o_totalprice / 100) AS INT) + CAST(o_custkey % 1700 AS INT) END",
    "bonus": "2 + CAST(o_orderkey % 160 AS DOUBLE) / 100",
}
_ITEMS = {
    "idx": "p_partkey",
    "y": "p_size % 2",
    "race": "CASE WHEN p_partkey % 2 = 0 THEN 'g0' ELSE 'g1' END",
    "prs": "CASE WHEN p_size % 7 = 6 THEN NULL ELSE CAST(p_size % 7 AS STRING) END",
    "ogs": "1 + CAST(p_partkey % 14 AS INT)",
    "incar": "CASE WHEN (p_partkey * 7 + p_size) % 5 < 2 THEN NULL ELSE 'yes' END",
    "crimecat": "p_type",
}
_DESCRIPTIONS = {"idx": "doc_id", "description": "text"}

_PLAIN = {
    "perception": (_PERCEPTION, "customer"),
    "demographics": (_DEMOGRAPHICS, "customer"),
    "times": (_TIMES, "orders"),
    "items": (_ITEMS, "part"),
    "descriptions": (_DESCRIPTIONS, "documents"),
}


def _list(columns: dict[str, str]) -> list[str]:
    return [f"{e} AS {n}" for n, e in columns.items()]


def assess(spark: SparkSession, folder: str) -> DataFrame:
    """Paired predictions: one row per (participant, item)."""
    lines = read_parquet(spark, folder, "lineitem")
    orders = read_parquet(spark, folder, "orders", ["o_orderkey", "o_custkey"])
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    return (
        joined.selectExpr(*_list(_BASE)).selectExpr("*", *_list(_SCORED)).selectExpr(*_list(_ASSESS))
        .withColumnRenamed("idx", "index")
    )


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    columns, table = _PLAIN[name]
    df = read_parquet(spark, folder, table).selectExpr(*_list(columns))
    return df.withColumnRenamed("idx", "index") if "idx" in columns else df


def _cte(name: str, columns: dict[str, str], source: str) -> str:
    return f"{name} AS (SELECT {', '.join(_list(columns))} FROM {source})"


_SQL = {
    "assess": ", ".join(
        [
            _cte("base", _BASE, "lineitem JOIN orders ON l_orderkey = o_orderkey"),
            f"scored AS (SELECT *, {', '.join(_list(_SCORED))} FROM base)",
            _cte("assess", _ASSESS, "scored"),
        ]
    ),
    **{name: _cte(name, columns, table) for name, (columns, table) in _PLAIN.items()},
}
# Answers of people, one row each.
_SQL["long"] = (
    "long AS ("
    "SELECT 'h' AS type, qp_h AS qp, qb_h AS qb, time_h AS time, * FROM assess WHERE qp_h IS NOT NULL"
    " UNION ALL SELECT 'hr', qp_hr, qb_hr, time_hr, * FROM assess WHERE qp_hr IS NOT NULL)"
)
_SQL["everyone"] = (
    "everyone AS ("
    "SELECT 'h' AS type, qp_h AS qp, qb_h AS qb, time_h AS time, * FROM assess WHERE qp_h IS NOT NULL AND qb_h IS NOT NULL"
    " UNION ALL SELECT 'hr', qp_hr, qb_hr, time_hr, * FROM assess WHERE qp_hr IS NOT NULL AND qb_hr IS NOT NULL"
    " UNION ALL SELECT 'r', qp_r, qb_r, NULL, * FROM assess WHERE qp_r IS NOT NULL AND qb_r IS NOT NULL)"
)
# People at the model's matched operating point, and the predictor ``re``.
_SQL["cut"] = (
    "goal AS (SELECT round_even(avg(qb), 3) AS rate FROM everyone WHERE type IN ('h', 'hr')), "
    "cut AS (SELECT max(i * 0.01::DOUBLE) AS threshold FROM range(101) t(i), goal "
    "WHERE (SELECT avg(CASE WHEN qp > i * 0.01::DOUBLE THEN 1 ELSE 0 END) FROM everyone WHERE type = 'r') >= rate)"
)
_SQL["matched"] = (
    "matched AS (SELECT type, qp, qb, id, survey_part, order_question, outcome FROM everyone "
    "UNION ALL SELECT 're', qp, CASE WHEN qp >= threshold THEN 1 ELSE 0 END, id, survey_part, order_question, outcome "
    "FROM everyone, cut WHERE type = 'r')"
)
# Accuracy of each participant per question set, with its descending percentile rank.
_SQL["accset"] = (
    "fst AS (SELECT * FROM everyone WHERE type <> 'r' AND NOT (type = 'h' AND survey_part = 2)), "
    "accraw AS (SELECT id, survey_part AS set_q, avg(CASE WHEN qb = outcome THEN 1 ELSE 0 END) AS acc FROM fst "
    "WHERE order_question < 6 AND survey_part <> 3 GROUP BY id, survey_part "
    "UNION ALL SELECT id, 3, avg(CASE WHEN qb = outcome THEN 1 ELSE 0 END) FROM fst WHERE survey_part = 2 GROUP BY id), "
    "accset AS (SELECT id, set_q, acc, 1 - row_number() OVER (PARTITION BY set_q ORDER BY acc, id) / count(*) OVER (PARTITION BY set_q) AS rank FROM accraw)"
)
_SQL["na"] = "na AS (SELECT * FROM assess WHERE survey_part = 2 AND setting = 'No anchor')"
# Perception answers parsed and recoded, one row per (participant, set).
_FRACTION = "TRY_CAST(split_part({c}, '/', 1) AS DOUBLE) / NULLIF(TRY_CAST(split_part({c}, '/', 2) AS DOUBLE), 0)"


def _recode(c: str, first: list[str], first_label: str, second: list[str], second_label: str, other: str) -> str:
    def quote(ts: list[str]) -> str:
        return ", ".join(f"'{t}'" for t in ts)

    return (
        f"CASE WHEN {c} IN ({quote(first)}) THEN '{first_label}' "
        f"WHEN {c} IN ({quote(second)}) THEN '{second_label}' ELSE '{other}' END"
    )


def _answers_sql(k: int) -> str:
    accuracy = f"humanaccuracy_{k}"
    text = f"CASE WHEN {accuracy} LIKE '%25%' THEN NULL ELSE {accuracy} END" if k == 2 else accuracy
    use = [
        f"{_FRACTION.format(c=f'use_{u}_{k}') if k > 1 else 'CAST(NULL AS DOUBLE)'} AS use_{u}"
        for u in ("binary", "likelihood")
    ]
    return (
        f"SELECT id, {k} AS set_q, {_FRACTION.format(c=text)} AS humanaccuracy, {', '.join(use)}, "
        f"{_recode(f'confidence_{k}', _LEVELS[3:], 'Confident', _LEVELS[:2], 'Not confident', 'Somewhat confident')} AS confidence, "
        f"{_recode(f'humanaccuracy_comparison_{k}', _RANKS[:2], 'Lower', [_RANKS[2]], 'Median', 'Higher')} AS humanaccuracy_comparison, "
        f"{f'trust_{k}' if k > 1 else 'CAST(NULL AS STRING)'} AS trust FROM perception"
    )


_SQL["answers"] = "answers AS (" + " UNION ALL ".join(_answers_sql(k) for k in (1, 2, 3)) + ")"
_NEEDS = {
    "long": ["assess"],
    "na": ["assess"],
    "answers": ["perception"],
    "everyone": ["assess"],
    "cut": ["assess", "everyone"],
    "matched": ["assess", "everyone", "cut"],
    "accset": ["assess", "everyone"],
}


def sql(body: str, *views: str) -> str:
    """``body`` with the named views in front of it; ``body`` may open with further views and a comma."""
    ordered: list[str] = []
    for v in views:
        for name in [*_NEEDS.get(v, []), v]:
            if name not in ordered:
                ordered.append(name)
    heads = ", ".join(_SQL[v] for v in ordered)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {heads}, {body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {heads}, {body[5:]}" if heads else body
    return f"WITH {heads} {body}" if heads else body
