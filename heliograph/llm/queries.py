"""Queries for training data (p6 to p10)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm import mixture, neighbourhood, tokens, topk, truncation
from heliograph.llm.page import page_key, seconds
from heliograph.runtime import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


# ---------------------------------------------------------------- p6

_P6_SQL = "select surt_key, count(*) as n from captures where surt_key is not null group by 1 order by n desc, surt_key limit 30"


@query("p6_found", f"select surt_key from ({_P6_SQL})")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return topk.most_frequent(table(spark, d, "captures"), "surt_key", 30).select(F.col("value").alias("surt_key"))


@query("p6_counts", _P6_SQL)
def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return topk.most_frequent(table(spark, d, "captures"), "surt_key", 30).withColumnRenamed("value", "surt_key")


# ---------------------------------------------------------------- p7


def _screened(spark: SparkSession, d: str) -> DataFrame:
    return neighbourhood.screen_batches(
        table(spark, d, "captures"), table(spark, d, "incoming_captures"), "batch_no", "rec_id", {"page": page_key(F.col("surt_key"))}, seconds(F.col("ts")), 5
    )


# Pages and seconds as SQL, then each page's rows decided one by one in order.
_P7_KEYS = """
  select *, coalesce(nullif(regexp_extract(low, '^[^)]*'), ''), '') as host, substr(low, length(regexp_extract(low, '^[^)]*')) + 1) as raw
  from (select *, lower(surt_key) as low, epoch(try_strptime(ts, '%Y%m%d%H%M%S'))::bigint as sec from {})
"""
_P7_SQL = """
with every as (select capture_id as id, 0 as batch_no, surt_key, ts from captures union all select rec_id, batch_no, surt_key, ts from incoming_captures),
keyed as (""" + _P7_KEYS.format("every") + """), decoded as (
  select *, regexp_replace(regexp_replace(host, ':(80|443)$', ''), '(^|,)www[0-9]*$', '') as site,
    case when contains(raw, '%') then array_to_string(list_transform(string_split(raw, '%'), lambda x, i:
      case when i = 1 then x when regexp_matches(x, '^([46][1-9a-f]|[57][0-9a]|3[0-9]|2[de]|5f|7e)')
      then lower(chr(('0x' || left(x, 2))::int)) || substr(x, 3) else '%' || x end), '') else raw end as rest
  from keyed where surt_key is not null and sec is not null
), pages as (
  select id, batch_no, sec, site || regexp_replace(split_part(rest, '?', 1), '/$', '') || case when params = '' then '' else '?' || params end as page
  from (select *, case when contains(rest, '?') then array_to_string(list_sort(list_filter(string_split(substr(rest, instr(rest, '?') + 1), '&'),
    lambda x: not (split_part(x, '=', 1) in ('sid', 'phpsessid', 'jsessionid') or starts_with(x, 'utm_')))), '&') else '' end as params from decoded)
), fresh as (
  select page, sec, min({'b': batch_no, 'i': id}) as place from pages n where batch_no > 0
  and not exists (select 1 from pages h where h.batch_no = 0 and h.page = n.page and h.sec between n.sec - 5 and n.sec + 5) group by all
), placed as (
  select page, sec, place.i as id, row_number() over (partition by page order by place) as k from fresh
), walk as (
  with recursive w as (
    select page, k, id, true as ok, [sec] as taken from placed where k = 1
    union all
    select p.page, p.k, p.id, len(list_filter(w.taken, lambda t: abs(t - p.sec) <= 5)) = 0,
      case when len(list_filter(w.taken, lambda t: abs(t - p.sec) <= 5)) = 0 then list_append(w.taken, p.sec) else w.taken end
    from w join placed p on p.page = w.page and p.k = w.k + 1
  ) select id from w where ok
)
"""


@query("p7_found", _P7_SQL + "select id as rec_id from pages where batch_no > 0 and id not in (select id from walk)")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _screened(spark, d).where("not accepted").select(F.col("id").alias("rec_id"))


@query(
    "p7_report",
    _P7_SQL + """select batch_no, count(*) as n_rows, count(*) - count_if(repeated) as n_accepted, count_if(repeated) as n_repeats
    from (select batch_no, rec_id in (select id from pages where batch_no > 0 and id not in (select id from walk)) as repeated from incoming_captures) group by 1""",
)
def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Per batch: rows, accepted and repeats."""
    counted = _screened(spark, d).groupBy(F.col("batch").alias("batch_no"))
    return counted.agg(F.count("*").alias("n_rows"), F.count_if("accepted").alias("n_accepted"), F.count_if(~F.col("accepted")).alias("n_repeats"))


# ---------------------------------------------------------------- p8


@query("p8_ids")
def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_documents(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "ids")


@query("p8_roundtrip", "select doc_id, coalesce(text, '') as text from documents")
def p8_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Every text encoded and decoded again."""
    tokenizer = tokens.Tokenizer()
    encoded = tokens.encode_documents(table(spark, d, "documents").select("doc_id", "text"), tokenizer)
    return tokenizer.decode(encoded).select("doc_id", "text")


# ---------------------------------------------------------------- p9


def _mixture(spark: SparkSession, d: str) -> mixture.Mixture:
    documents = tokens.count_tokens(table(spark, d, "documents").select("doc_id", "source", "text"))
    return mixture.Mixture(documents, table(spark, d, "mix_targets"))


@query("p9_uses")
def p9_uses(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).uses()


@query("p9_shares")
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).shares()


@query("p9_shuffled")
def p9_shuffled(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).shuffled()


_P9_QUOTAS = """
with held as (select trim(lower(source), ' ') as source, sum(length(text)) as held from documents where text is not null group by 1
), wanted as (select trim(lower(source), ' ') as source, sum(target_share) as weight, max(max_repeats) as repeats from mix_targets where source is not null group by 1
), caps as (select w.source, weight, repeats, coalesce(held, 0) as held, coalesce(held, 0) * repeats as cap from wanted w left join held h using (source)
), open as (select *, row_number() over (order by cap / weight, source) as k, (select sum(held) from caps) as whole from caps where weight > 0
), levels as (
  -- Sources fill up in order of cap by weight; what is left then is shared by weight.
  select *, (whole - coalesce(sum(cap) over before, 0)) / (sum(weight) over after) as level from open
  window before as (order by k rows between unbounded preceding and 1 preceding), after as (order by k rows between current row and unbounded following)
), last as (select arg_min(level, k) filter (where cap > level * weight) as level from levels)
select source, repeats as max_repeats, cast(held as bigint) as held, cast(round(coalesce(least(cap, (select level from last) * weight), cap)) as bigint) as quota
from caps
"""


@query("p9_quotas", _P9_QUOTAS)
def p9_quotas(spark: SparkSession, d: str) -> DataFrame:
    """What each source has to give if sizes are counted in characters, which SQL can count."""
    documents = table(spark, d, "documents").withColumn("n_tokens", F.length("text"))
    shares = mixture.Mixture(documents, table(spark, d, "mix_targets")).shares()
    return shares.select("source", "max_repeats", F.col("held_tokens").alias("held"), F.col("quota_tokens").alias("quota"))


@query("p9_kept", _P9_QUOTAS.replace("select source, repeats as", "select source, true as in_quota, true as in_cap, repeats as").split(", repeats as max_repeats, cast(held")[0] + " from caps")
def p9_kept(spark: SparkSession, d: str) -> DataFrame:
    """Whether every source's drawn tokens are its quota, up to its longest document, within its cap."""
    m = _mixture(spark, d)
    longest = m.documents.groupBy("source").agg(F.max("tokens").alias("longest"))
    both = m.shares().join(longest, "source", "left")
    near = F.abs(F.col("tokens") - F.col("quota_tokens")) <= F.coalesce("longest", F.lit(0)) + 1
    return both.select("source", near.alias("in_quota"), (F.col("most_uses") <= F.col("max_repeats")).alias("in_cap"))


# ---------------------------------------------------------------- p10


@query("p10_found")
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated_texts(table(spark, d, "documents")).select("doc_id")


@query("p10_report")
def p10_report(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return truncation.truncation_report(documents, truncation.truncated_texts(documents))
