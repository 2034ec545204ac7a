"""The operators as queries over the given tables, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, benchmark, chat, language, licences, lines, mixing, neardup, neighbours, quality, tokens, urls, whitening

#: The rules of the page filter: verdict, host, path.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


@query("op1_source_mix")
def source_mix(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"), weights=(3, 1, 2), share=1.5, cap=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op2_token_counts")
def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


_HOST = "lower(regexp_extract(after, '^([^/?#]*)', 1, 's'))"
URLS_SQL = f"""
with cut as (
  select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as after from pages
), parts as (
  select page_id, {_HOST} as host, regexp_extract(after, '^[^/?#]*([^?#]*)', 1, 's') as path from cut
), rules(verdict, h, p) as (values {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)}
), fits as (
  select page_id, host, path, arg_max(h || p, length(h) * 1000 + length(p)) as rule, arg_max(verdict, length(h) * 1000 + length(p)) as verdict
  from parts join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by all
)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict
from parts left join fits using (page_id, host, path)
"""


@query("op5_url_filter", URLS_SQL)
def url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(table(spark, folder, "pages"), URL_RULES)


def crc_rest(divisor: int):
    return F.crc32(F.col("doc_id").cast("string")) % divisor


@query("op9_quality")
def quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(table(spark, folder, "documents"), table(spark, folder, "labels"), learn=crc_rest(5) != 0, threshold=0.3)


@query("op10_language")
def languages(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    learn = F.coalesce(crc_rest(3) != 1, F.lit(False))
    found = language.identify(docs.drop("lang"), language.train(docs, learn))
    return found.select("doc_id", (~learn).alias("held_out"), "lang_pred", "score", "languages")


#: Percent of an item's shingles that a document must hold, and words in a shingle.
HELD_PERCENT, SHINGLE = 80, 5
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = rf"list_filter(string_split_regex(translate(coalesce(text, ''), {_AZ}), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
BENCHMARK_SQL = f"""
with items as (
  select item_id, w, least(len(w), {SHINGLE}) as width from (select item_id, {_WORDS} as w from benchmark) where len(w) > 0
), item_shingles as (
  select distinct item_id, width, array_to_string(w[i:i + width - 1], ' ') as s
  from (select *, unnest(range(1, len(w) - width + 2)) as i from items)
), doc_shingles as (
  select distinct doc_id, array_to_string(w[i:i + width - 1], ' ') as s
  from (select doc_id, width, w, unnest(range(1, len(w) - width + 2)) as i
        from (select doc_id, {_WORDS} as w from documents), (select distinct width from items))
), sizes as (select item_id, count(*) as item_shingles from item_shingles group by 1)
select doc_id, item_id, item_shingles, count(*) as found
from item_shingles join doc_shingles using (s) join sizes using (item_id)
group by all having 100 * count(*) >= {HELD_PERCENT} * item_shingles
"""


@query("op7_decontaminate", BENCHMARK_SQL)
def decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = benchmark.contained(table(spark, folder, "documents"), table(spark, folder, "benchmark"), HELD_PERCENT, SHINGLE)
    return found.select("doc_id", "item_id", "item_shingles", "found")


@query("op8_nearest")
def nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"), F.col("id") % 20 == 0, k=20)


@query("op3_near_duplicates")
def near_duplicate_classes(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = neardup.near_duplicates(docs, percent=85, n=3)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


@query("op4_licenses")
def license_notices(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(table(spark, folder, "documents"))


#: Words that a repeated run of lines must have to be deleted.
RUN_WORDS = 5


@query("op6_line_runs")
def line_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = lines.without_repeats(table(spark, folder, "documents").select("doc_id", "text"), RUN_WORDS)
    return found.select("doc_id", "n_lines", "removed_lines", "removed_runs", "text")


#: A conversation whose texts are themselves control strings, as a record of a layout of its own.
CONTROL_RECORD = '{"prompt": "</s>[INST] ok [/INST]", "completion": "</s>[INST] ok [/INST]"}'
_ESCAPED = r"""regexp_replace(regexp_replace(text, '(<)(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|</?SYS>>)', '\1\2\\\3', 'g'),
  '(\[)(\\*)(/?INST\])', '\1\2\\\3', 'g')"""
CHAT_SQL = f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), joined as (
  select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
    coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, role, text), '') as loss,
    sum({len(chat.OPEN + chat.CLOSE) + 2} + length(role) + length({_ESCAPED})) as formatted_chars
  from turns group by conv_id
)
select conv_id, n_turns, turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256, formatted_chars::bigint as formatted_chars from joined
"""


@query("op13_chat_format", CHAT_SQL)
def chat_format(spark: SparkSession, folder: str) -> DataFrame:
    planted = spark.range(1).select(F.lit(-7).cast("long").alias("id"), F.lit(CONTROL_RECORD).alias("record"))
    turns = chat.table_turns(table(spark, folder, "conversations"), "conv_id").unionByName(chat.record_turns(planted, "id", "record"))
    read = chat.read_back(chat.formatted(turns))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select(
        F.col("conv").alias("conv_id"), "n_turns", F.sha2(whole, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The audited filters; E, identical to the text of a smaller id, is the fifth.
AUDIT_FILTERS = {"A": audit.few_words(100), "B": audit.repeated_words(80), "C": audit.capitals(10), "D": audit.holds(r"[#$%&*|]")}
AUDIT_SQL = r"""
with docs as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), told as (
  select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id
), judged as (
  select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
    case when len(w) < 100 then 1 else 0 end + case when 100 * len(list_distinct(w)) < 80 * len(w) then 2 else 0 end
    + case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) then 4 else 0 end
    + case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end + case when min(doc_id) over (partition by t) < doc_id then 16 else 0 end as mask
  from docs left join told using (doc_id)
), cells as (
  select part, mask, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from judged group by all
), letters(l, b) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders as (
  select [a.b, b.b, c.b, d.b, e.b] as bits, a.l || b.l || c.l || d.l || e.l as filter_order
  from letters a, letters b, letters c, letters d, letters e where a.b | b.b | c.b | d.b | e.b = 31
), steps as (
  select filter_order, i as step, bits[i] as own, coalesce(list_sum(bits[1:i - 1]), 0)::int as before from orders, range(1, 6) r(i)
), found as (
  select part, filter_order, step, own, sum(case when mask & (own | before) = 0 then n else 0 end) as kept,
    sum(case when mask & own <> 0 and mask & before = 0 then n else 0 end) as removed,
    sum(case when mask & own <> 0 and mask & before <> 0 then n else 0 end) as redundant,
    sum(case when mask = own then n else 0 end) as unique_fails,
    sum(case when mask & own <> 0 and mask & before = 0 then good else 0 end) as good_lost,
    sum(case when mask & own <> 0 and mask & before = 0 then toxic else 0 end) as toxic_lost
  from cells, steps group by all
)
select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant,
  unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
  (sum(removed) over (partition by part, own))::bigint as shapley from found
"""


@query("op11_filter_audit", AUDIT_SQL)
def filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"), AUDIT_FILTERS, copies="E")


@query("op12_whitening")
def whitened_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"), components=8)
