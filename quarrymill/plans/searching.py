"""Search queries over embeddings and documents, and telemetry over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymill.functions.stemming import STOP_WORDS, stem_sql
from quarrymill.functions.literals import values
from quarrymill.operators import postings, search, telemetry
from quarrymill.plans.tables import table

#: The query vector of the tests: the alternating unit vector of 64 dimensions.
QUERY = [0.125 if i % 2 else -0.125 for i in range(64)]
_DOT = "list_sum(list_transform(range(1, 65), lambda i: embedding[i]::double * (case when i % 2 = 1 then -0.125 else 0.125 end)))"
_NORM = "sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double)))"
_DIST = f"1 - {_DOT} / {_NORM}"
TERMS = ["the", "from", "was"]
_WORDS = "regexp_split_to_array(lower(text), '[^a-z]+')"
_HITS = " + ".join(f"list_contains({_WORDS}, '{t}')::int" for t in TERMS)


def vector_topk(s, d):
    return search.vector_leg(table(s, d, "embeddings"), "embedding", "vec_id", QUERY).select("vec_id", F.round("dist", 6).alias("dist"), "rank_v")


def vector_topk_capped(s, d):
    return search.vector_leg(table(s, d, "embeddings"), "embedding", "vec_id", QUERY, 60, "label", 8).select("vec_id", "label", "rank_v")


def text_or_match_topk(s, d):
    return search.text_leg(table(s, d, "documents"), "text", "doc_id", TERMS).select("doc_id", "text_score", "rank_t")


#: What the indexed legs are asked: words of the texts, inflected, among stop words.
ASKED = "the tions of annd, therings and what ATION was doing with inge"


def text_bm25_topk(s, d):
    """English full text ranked by BM25 from postings, a term's part to 12 places, ties by key; scores to six places."""
    index = postings.index_of(table(s, d, "documents"), "doc_id", "text")
    return postings.indexed_leg(index, "doc_id", ASKED, 60, "bm25").select("doc_id", F.round("text_score", 6).alias("text_score"), "rank_t")


def text_density_topk(s, d):
    """The same texts ranked by the density of the query's terms, within those of three languages; a term's part to 12 places, ties by key."""
    docs = table(s, d, "documents")
    found = postings.indexed_leg(postings.index_of(docs, "doc_id", "text"), "doc_id", ASKED, 60, within=docs.where("lang in ('en', 'de', 'fr')"))
    return found.select("doc_id", F.round("text_score", 9).alias("text_score"), "rank_t")


def rrf_fusion(s, d):
    v = search.vector_leg(table(s, d, "embeddings"), "embedding", "vec_id", QUERY).select("vec_id", "rank_v")
    t = search.text_leg(table(s, d, "documents").withColumnRenamed("doc_id", "vec_id"), "text", "vec_id", TERMS)
    return search.fuse(v, t, "vec_id").select("vec_id", "rank_v", "rank_t", F.round("score", 9).alias("score"))


def hybrid_search(s, d):
    """Documents with the embedding of their number, in English, diversified by language and label; a term's part of the text leg to 12 places, ties by key."""
    vec = table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    docs = table(s, d, "documents")
    rows = docs.where("n_chars > 300").join(vec, "doc_id")
    found = search.hybrid(rows, "doc_id", "embedding", "text", "lang", "label", QUERY, ASKED, index=postings.index_of(docs, "doc_id", "text"))
    return found.select("doc_id", "rank_v", "rank_t", "place")


_V = f"v as (select vec_id, rank_v from (select vec_id, row_number() over (order by {_DIST}, vec_id) as rank_v from embeddings) where rank_v <= 60)"
_T = f"t as (select doc_id, hits::double as text_score, row_number() over (order by hits desc, doc_id) as rank_t from (select doc_id, {_HITS} as hits from documents) where hits > 0 order by hits desc, doc_id limit 60)"
_X = ", ".join(f"'{w}'" for w in sorted(STOP_WORDS))
#: English full text by plain SQL: the terms of every text by the stemmer's rules as SQL, and how often each is held.
_FULL = f"""words as (select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) as w from documents),
  stems as (select w, {stem_sql("w")} as term from (select distinct w from words) where w not in ({_X})),
  held as (select doc_id, term, count(*) as tf from words join stems using (w) group by 1, 2),
  asked as (select distinct {stem_sql("w")} as term from (select unnest(regexp_extract_all(lower('{ASKED}'), '[a-z]+')) as w) where w not in ({_X}))"""
#: Each term's part counts to 12 places and adds up as a whole number, as in ``postings.matches``: in any order alike, so texts that match alike tie and the key decides.
_PART = "list_sum(list_transform(range(1, least(tf, 255) + 1), lambda i: 1.0::double / (i * i))) * 0.1::double / 1.64493406685::double"
_DENSITY = f"sum(round({_PART} * 1e12)::bigint)::double / 1e12 / (select count(*) from asked)"


def metric_bucket(width, aggs):
    return lambda s, d: telemetry.bucketed(table(s, d, "events"), "ts", width, *aggs())


def zero_result_rate(s, d):
    rows = table(s, d, "events")
    return rows.groupBy("user_id").agg(F.round(telemetry.share(F.col("event_type") == "error"), 6).alias("rate"))


def zero_result_rate_24h(s, d):
    rows = telemetry.since(table(s, d, "events"), "ts", F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), 24).where("ts <= timestamp_ntz '2024-01-20 00:00:00'")
    return rows.agg(F.round(telemetry.share(F.col("event_type") == "error"), 6).alias("rate"), F.count("*").alias("n"))


def count_by_coalesce(s, d):
    kind = F.coalesce(F.nullif(F.col("event_type"), F.lit("view")), F.lit("(none)"))
    return table(s, d, "events").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def log_totals(s, d):
    cents = F.sum(F.col("value").cast("decimal(12,2)")).cast("double")
    return table(s, d, "events").agg(F.count("*").alias("n"), cents.alias("total"), F.round(cents / F.count("value"), 6).alias("mean"))


def recent_log(s, d):
    return table(s, d, "events").orderBy(F.desc("event_id")).limit(50).select("event_id", "event_type")


#: Dollars a million tokens, in and out, by model; the test's values.
PRICES = [("click", 2.0, 8.0), ("view", 0.15, 0.6), ("purchase", 0.02, 0.0)]


def cost_estimate(s, d):
    """Cost of a call by its model's prices; an unknown model's is null, and a sum of two parts is null only if both are."""
    price = values(s, PRICES, ["event_type", "p_in", "p_out"]).select("event_type", F.col("p_in").cast("double"), F.col("p_out").cast("double"))
    rows = table(s, d, "events").join(F.broadcast(price), "event_type", "left")  # a price list of a few rows
    k = F.get_json_object("props", "$.k").cast("double")
    one = telemetry.cost(k * 100, k * 10, F.col("p_in"), F.col("p_out"))
    other = telemetry.cost(k, k, F.when(F.col("user_id") % 2 == 0, 1.0), F.when(F.col("user_id") % 2 == 0, 1.0))
    return rows.select("event_id", one.alias("extract_cost"), telemetry.cost_sum(one, other).alias("cost"))


def json_props(s, d):
    k = F.get_json_object("props", "$.k")
    return table(s, d, "events").where(k.isNotNull()).groupBy(k.cast("long").alias("k")).agg(F.count("*").alias("n"))


def sessions_dedupe(s, d):
    """The first event of each user and kind, whatever order they come in (a sign-up list)."""
    return table(s, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


QUERIES = {
    "vector_topk": (vector_topk, f"select vec_id, round(dist, 6) as dist, row_number() over (order by dist, vec_id) as rank_v from (select vec_id, {_DIST} as dist from embeddings) order by dist, vec_id limit 60"),
    "vector_topk_capped": (vector_topk_capped, f"with c as (select vec_id, label, dist from (select vec_id, label, {_DIST} as dist, row_number() over (partition by label order by {_DIST}, vec_id) as rn from embeddings) where rn <= 8) select vec_id, label, row_number() over (order by dist, vec_id) as rank_v from c order by dist, vec_id limit 60"),
    "text_or_match_topk": (text_or_match_topk, f"with {_T} select doc_id, text_score, rank_t from t"),
    "text_bm25_topk": (text_bm25_topk, f"""with {_FULL}, sizes as (select doc_id, coalesce(n, 0) as n from documents left join (select doc_id, sum(tf) as n from held group by 1) using (doc_id)),
      stats as (select count(*) as docs, avg(n) as mean from sizes), dfs as (select term, count(*) as df from held group by 1),
      sc as (select doc_id, sum(round(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean)) * 1e12)::bigint)::double / 1e12 as score from held join asked using (term) join dfs using (term) join sizes using (doc_id), stats group by 1)
      select doc_id, round(score, 6) as text_score, row_number() over (order by score desc, doc_id) as rank_t from sc order by score desc, doc_id limit 60"""),
    "text_density_topk": (text_density_topk, f"with {_FULL}, sc as (select doc_id, {_DENSITY} as score from held join asked using (term) join documents using (doc_id) where lang in ('en', 'de', 'fr') group by 1) select doc_id, round(score, 9) as text_score, row_number() over (order by score desc, doc_id) as rank_t from sc order by score desc, doc_id limit 60"),
    "rrf_fusion": (rrf_fusion, f"with {_V}, {_T} select coalesce(v.vec_id, t.doc_id) as vec_id, rank_v, rank_t, round(coalesce(0.7 / (60 + rank_v), 0) + coalesce(0.3 / (60 + rank_t), 0), 9)::double as score from v full join t on vec_id = doc_id"),
    "hybrid_search": (hybrid_search, f"""with {_FULL}, c as (select doc_id, text, lang, embedding, label from documents join embeddings on doc_id = vec_id where n_chars > 300),
      n as (select doc_id, dist from (select doc_id, {_DIST} as dist, row_number() over (partition by label order by {_DIST}, doc_id) as rn from c) where rn <= 8),
      v as (select doc_id, row_number() over (order by dist, doc_id) as rank_v from n order by dist, doc_id limit 60),
      h as (select doc_id, {_DENSITY} as hits from held join asked using (term) join c using (doc_id) group by 1),
      t as (select doc_id, row_number() over (order by hits desc, doc_id) as rank_t from h where hits > 0 order by hits desc, doc_id limit 60),
      f as (select coalesce(v.doc_id, t.doc_id) as doc_id, rank_v, rank_t, coalesce(0.7::double / (60 + rank_v), 0) + coalesce(0.3::double / (60 + rank_t), 0) as score from v full join t on v.doc_id = t.doc_id),
      p as (select f.*, lang as cat, label::varchar as br, row_number() over (order by score desc, rank_v nulls last, rank_t nulls last, f.doc_id) as pos from f join c using (doc_id)),
      q as (select *, row_number() over (partition by cat, br order by pos) as rb, min(pos) over (partition by cat, br) as bp, min(pos) over (partition by cat) as cp from p),
      k as (select *, row_number() over (partition by cat order by rb, bp) as k from q)
      select doc_id, rank_v, rank_t, place from (select *, row_number() over (order by k, cp) as place from k) where place <= 50"""),
    "metric_bucket_15m": (metric_bucket("15 minutes", lambda: [F.count("*").alias("n"), F.max("value").alias("most")]), "select time_bucket(interval 15 minutes, ts) as bucket, count(*) as n, max(value) as most from events group by 1"),
    "metric_bucket_1h": (metric_bucket("1 hour", lambda: [F.sum(F.col("value").cast("decimal(12,2)")).cast("double").alias("total"), F.sum(F.nullif(F.col("event_id") % 3, F.lit(0)) + F.col("event_id") % 5).alias("tokens")]), "select date_trunc('hour', ts) as bucket, sum(value::decimal(12,2))::double as total, sum(nullif(event_id % 3, 0) + event_id % 5)::bigint as tokens from events group by 1"),
    "zero_result_rate": (zero_result_rate, "select user_id, round(100.0::double * count(*) filter (event_type = 'error') / count(*), 6) as rate from events group by 1"),
    "zero_result_rate_24h": (zero_result_rate_24h, "select round(coalesce(100.0::double * count(*) filter (event_type = 'error') / nullif(count(*), 0), 0), 6) as rate, count(*) as n from events where ts > timestamp '2024-01-19' and ts <= timestamp '2024-01-20'"),
    "count_by_coalesce": (count_by_coalesce, "select coalesce(nullif(event_type, 'view'), '(none)') as kind, count(*) as n from events group by 1"),
    "log_totals": (log_totals, "select count(*) as n, sum(value::decimal(12,2))::double as total, round(sum(value::decimal(12,2))::double / count(value), 6) as mean from events"),
    "recent_log": (recent_log, "select event_id, event_type from events order by event_id desc limit 50"),
    "cost_estimate": (cost_estimate, "with e as (select event_id, user_id, (json_extract_string(props, '$.k'))::double as k, case event_type when 'click' then 2.0 when 'view' then 0.15 when 'purchase' then 0.02 end::double as pi, case event_type when 'click' then 8.0 when 'view' then 0.6 when 'purchase' then 0.0 end::double as po from events), c as (select event_id, round(k * 100 / 1e6 * pi + k * 10 / 1e6 * po, 6) as a, case when user_id % 2 = 0 then round(k / 1e6 * 1.0 + k / 1e6 * 1.0, 6) end as b from e) select event_id, a as extract_cost, case when a is not null or b is not null then coalesce(a, 0) + coalesce(b, 0) end as cost from c"),
    "json_props": (json_props, "select json_extract_string(props, '$.k')::bigint as k, count(*) as n from events where json_extract_string(props, '$.k') is not null group by 1"),
    "signup_dedupe": (sessions_dedupe, "select user_id, event_type, min(event_id) as event_id from events group by 1, 2"),
}
