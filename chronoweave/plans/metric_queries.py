"""Registered queries: retrieval and answer metrics, analytics rows and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from chronoweave.operators import analytics as an, evaluation as ev, retrieval as rt
from chronoweave.operators.ordered import keep_top
from chronoweave.plans import fixtures as fx
from chronoweave.plans.common import conflicts, flat, led, revs, sql, src, stored
from chronoweave.operators.embedding import HASH_MODEL
from chronoweave.plans.retrieval_queries import DIMS, _SEARCH, _runs, docs, embedded, questions
from chronoweave.session import checkpoint_root
from chronoweave.sources import eval_io

# --- retrieval evaluation ------------------------------------------------------------------------


def _ranked(s, d):
    """Three configurations of every question in one search job; at most 20 keys per list."""

    def make():
        q = ev.with_configurations(questions(s, d))
        found = rt.search(
            led(s, d), src(s, d), q, revocations=revs(s, d), embeddings=embedded(s, d), docs=docs(s, d), model=HASH_MODEL, dims=DIMS
        )
        keys = found.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("position", "id"))).alias("k")).select(
            "question_id", F.transform("k", lambda x: x["id"].cast("string")).alias("ranked_keys")
        )
        none = F.array().cast("array<string>")
        n = F.substring("case_id", 2, 20).cast("long")
        return q.select("question_id", "case_id", "configuration", n.alias("n")).join(keys, "question_id", "left").select(
            "case_id", "configuration", F.coalesce("ranked_keys", none).alias("ranked_keys"),
            F.round((F.col("n") * 37 % 1009) * 1.25 + F.length("configuration"), 2).alias("latency_ms"), F.lit("used").alias("vector_search"),
        )

    return stored(s, d, "ranked", make)


def _cases(s, d):
    """Relevant: what the asker may see of the asked user from the first three sources; the two
    other sources count as revoked and private. A user has one valid version per property."""
    q, _ = rt.normalize_questions(questions(s, d).drop("properties", "min_authority", "min_confidence"))
    rows = rt.searchable(led(s, d), revs(s, d))
    asks = q.withColumn("external_id", F.regexp_extract("query", "([0-9]+)$", 1)).select(
        "question_id", "organization_id", "external_id", *[F.col(c).alias(f"q_{c}") for c in rt._ASK_SIDE]
    )
    seen = rows.join(asks, ["organization_id", "external_id"]).where(rt.eligible_pair())
    key = F.col("id").cast("string")
    per = seen.groupBy("question_id").agg(
        F.collect_list(F.when(F.col("source_id") < 3, key)).alias("relevant"),
        F.map_from_entries(F.collect_list(F.when(F.col("source_id") >= 3, F.struct(key, F.when(F.col("source_id") == 3, "revoked").otherwise("privacy"))))).alias("forbidden"),
    )
    return q.select("question_id", F.element_at(F.split(F.trim("query"), " "), 3).alias("category")).join(per, "question_id", "left").select(
        F.col("question_id").alias("case_id"), "category", F.coalesce("relevant", F.array().cast("array<string>")).alias("relevant"),
        F.coalesce("forbidden", F.create_map().cast("map<string,string>")).alias("forbidden"),
    )


def outcomes(s, d):
    return stored(s, d, "outcomes", lambda: ev.outcomes(_ranked(s, d), _cases(s, d)))


_EVAL = f"""
with {_SEARCH.strip()},
nt as (select question_id, id, row_number() over (partition by question_id order by rrf_score desc, id) as position, lim from scored),
tz as (select x.question_id, x.id, q.lim, 1.0::double / (60 + text_rank) * ((1 - 0.3::double) + 0.3::double * (l.authority / 100.0::double * l.confidence::double)) as score
  from txr x join led l using (id) join q using (question_id)),
ty as (select *, row_number() over (partition by question_id order by score desc, id) as position from tz),
ranked as (select 'hybrid' as configuration, question_id, id, position from win union all select 'hybrid_no_trust', question_id, id, position from nt where position <= lim
 union all select 'text_only', question_id, id, position from ty where position <= lim),
marked as (select q.question_id, q.property as category, l.id, l.source_id from q join led l on l.organization_id = q.organization_id and l.external_id = q.external_id left join revs r on r.fact_version_id = l.id
 where l.valid_from <= q.valid_at and (q.known_at is null or l.recorded_at <= q.known_at) and (l.valid_until is null or l.valid_until > q.valid_at or coalesce(l.valid_until_recorded_at > q.known_at, false))
  and (r.fact_version_id is null or coalesce(r.revoked_at > q.known_at, false)) and (case l.privacy_scope when 'PUBLIC' then 0 when 'INTERNAL' then 1 when 'CONFIDENTIAL' then 2 else 3 end) <= q.ceiling),
cs as (select q.question_id, q.qid, q.property as category, count(m.id) filter (source_id < 3) as rel, count(m.id) filter (source_id = 3) as tmp, count(m.id) filter (source_id = 4) as auth
 from q left join marked m using (question_id) group by 1, 2, 3),
hits as (select r.configuration, r.question_id, r.position, m.source_id from ranked r left join marked m on m.question_id = r.question_id and m.id = r.id),
pc as (select c.name as configuration, cs.*, round((qid * 37 % 1009) * 1.25 + length(c.name), 2) as latency_ms,
  (select min(position) from hits h where h.configuration = c.name and h.question_id = cs.question_id and h.source_id < 3) as first,
  (select count(*) from hits h where h.configuration = c.name and h.question_id = cs.question_id and h.source_id < 3 and position <= 1) as f1,
  (select count(*) from hits h where h.configuration = c.name and h.question_id = cs.question_id and h.source_id < 3 and position <= 3) as f3,
  (select count(*) from hits h where h.configuration = c.name and h.question_id = cs.question_id and h.source_id < 3 and position <= 5) as f5,
  (select count(*) from hits h where h.configuration = c.name and h.question_id = cs.question_id and h.source_id < 3 and position <= 10) as f10,
  (select coalesce(sum(1 / log2(position + 1)), 0) from hits h where h.configuration = c.name and h.question_id = cs.question_id and h.source_id < 3 and position <= 3) as dcg3,
  (select count(*) from hits h where h.configuration = c.name and h.question_id = cs.question_id and h.source_id = 3) as vt,
  (select count(*) from hits h where h.configuration = c.name and h.question_id = cs.question_id and h.source_id = 4) as va
 from cs, (values ('hybrid'), ('hybrid_no_trust'), ('text_only')) c(name))"""


def _case_metrics(s, d):
    m = ev.case_metrics(outcomes(s, d))
    return m.select(
        "configuration", "case_id", F.round("rr", 6).alias("rr"), F.round("recall_at_3", 6).alias("recall_at_3"),
        F.round("recall_at_10", 6).alias("recall_at_10"), F.round("precision_at_5", 6).alias("precision_at_5"),
        F.round("ndcg_at_3", 6).alias("ndcg_at_3"), F.size("violations").alias("violations"),
    )


def _summary(s, d):
    m = ev.summarize(outcomes(s, d))
    r = lambda c: F.round(c, 3).alias(c)  # noqa: E731  (rates are rounded to 4 places by both engines' own rules)
    return m.select(
        "configuration", "cases", "cases_with_relevant_facts", r("mrr"), r("recall_at_1"), r("recall_at_5"), r("precision_at_3"), r("ndcg_at_3"),
        r("temporal_correctness"), r("authorization_correctness"), "forbidden_results", "latency_ms_p50",
    )


# --- answer evaluation -----------------------------------------------------------------------------


def _answer_cases(s, d):
    """One evaluated answer per event."""
    e = fx.table(s, d, "events")
    i = F.col("event_id")
    status = F.when(i % 7 == 0, "error").when(i % 7 == 1, "ungrounded").when(i % 7 == 2, "insufficient_evidence").otherwise("answered")
    return e.select(
        i.alias("case_id"), F.when(i % 2 == 0, "v1").otherwise("v2").alias("prompt"),
        F.when(i % 5 == 0, "temporal").when(i % 5 == 1, "superseded").otherwise(F.col("event_type")).alias("category"),
        F.when(i % 4 == 0, "insufficient_evidence").otherwise("answered").alias("expected_status"), status.alias("status"),
        (i % 9 != 0).alias("model_called"), (i % 11 != 0).alias("context_has_expected"),
        F.when(i % 13 == 0, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array().cast("array<string>")).alias("context_leaks"),
        (i % 3 != 0).alias("answer_matches"), (i % 6 != 1).alias("citations_cover_expected"), (i % 4).cast("int").alias("rejected_citations"),
        F.when(i % 14 == 0, "MalformedGenerationError").when(i % 7 == 0, "Timeout").alias("error"),
        (i % 100).alias("input_tokens"), (i % 40).alias("output_tokens"), F.round(F.col("value"), 2).alias("generation_ms"),
    )


_ANSWERS = """
with c as (select event_id as i, case when event_id % 2 = 0 then 'v1' else 'v2' end as prompt,
  case event_id % 5 when 0 then 'temporal' when 1 then 'superseded' else event_type end as category,
  case when event_id % 4 = 0 then 'insufficient_evidence' else 'answered' end as expected,
  case event_id % 7 when 0 then 'error' when 1 then 'ungrounded' when 2 then 'insufficient_evidence' else 'answered' end as status,
  event_id % 9 <> 0 as called, round(value, 2) as ms from events),
k as (select *, status = expected and (expected = 'insufficient_evidence' or (i % 3 <> 0 and i % 6 <> 1)) as correct from c)"""


def _answer_metrics(s, d):
    m = ev.answer_metrics(_answer_cases(s, d), ["prompt"], price_input_per_million=3.0, price_output_per_million=15.0)
    rates = [c for c in m.columns if c not in ("prompt", "errors", "input_tokens", "output_tokens", "estimated_cost_usd", "latency_ms_p50", "latency_ms_p95")]
    return m.select(
        "prompt", *[F.round(c, 2 if c.endswith("mean") else 3).alias(c) for c in rates], "errors", "input_tokens", "output_tokens",
        F.round("estimated_cost_usd", 6).alias("estimated_cost_usd"), "latency_ms_p50", "latency_ms_p95",
    )


def _pipeline(s, d):
    m = ev.pipeline_metrics(_answer_cases(s, d), ["prompt"])
    return m.withColumn("context_correctness", F.round("context_correctness", 3)).withColumn("expected_facts_supplied", F.round("expected_facts_supplied", 3))


def _guard(s, d):
    c = fx.table(s, d, "events").select(
        F.when(F.col("event_id") % 3 == 0, F.array(F.lit("F99"))).otherwise(F.array().cast("array<string>")).alias("rejected_labels"),
        F.when(F.col("event_id") % 3 == 0, F.when(F.col("event_id") % 33 == 0, "insufficient_evidence").otherwise("ungrounded")).otherwise("answered").alias("status"),
    )
    return ev.guard_rate(c).select(F.round("guard_rate", 6).alias("guard_rate"))


# --- analytics -----------------------------------------------------------------------------------------


def _results(s, d):
    """One evaluation run per conversation: its turns are the cases, their words the ranked keys."""
    c = fx.table(s, d, "conversations")
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)
    case = F.struct(
        F.concat(F.lit("turn-"), F.lpad(F.col("turn").cast("string"), 4, "0")).alias("case_id"), F.col("role").alias("category"), words.alias("ranked_keys"),
        F.array(F.lit("the"), F.lit("de"), F.lit("und")).alias("relevant"), F.create_map().cast("map<string,string>").alias("forbidden"),
        (F.length("text") * 0.25).alias("latency_ms"), F.lit("used").alias("vector_search"),
        F.filter(words, lambda w: w == "of").alias("violations"),
    )
    runs = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.collect_list(case).alias("cs"), F.sum(F.length("text")).alias("chars"))
    i = F.col("conv_id")
    when = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), (i % 720).cast("int"))
    metric = F.create_map(
        F.lit("cases"), F.col("n").cast("string"), F.lit("mrr"), F.round(F.col("chars") % 1000 / 1000, 4).cast("string"),
        F.lit("recall@5"), F.round(F.col("chars") % 777 / 777, 4).cast("string"), F.lit("ndcg@5"), F.round(F.col("chars") % 555 / 555, 4).cast("string"),
        F.lit("by_category"), F.lit("{}"),
    )
    return runs.select(
        F.lit("retrieval-evaluation").alias("kind"), F.concat(F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".5+00:00")).alias("date"),
        F.sha2(i.cast("string"), 256).alias("commit_sha"), F.when(i % 3 == 0, True).alias("working_tree_dirty"),
        F.struct(F.lit("set").alias("name"), F.lit("1.0").alias("version"), F.when(i % 5 == 0, False).alias("synthetic"), F.col("n").cast("int").alias("cases")).alias("dataset"),
        F.struct(F.lit(fx.MODEL).alias("embedding_model")).alias("configuration"),
        F.create_map(F.lit("hybrid"), metric, F.lit("text_only"), metric).alias("metrics"),
        F.create_map(F.lit("hybrid"), F.col("cs")).alias("cases"),
    )


def _read_results(s, d):
    """Evaluation runs written as result files of both kinds and read back; the other kind is left out."""
    folder = f"{checkpoint_root(s)}/chronoweave/{s.sparkContext.applicationId}/results-{uuid.uuid4().hex[:12]}"
    r = _results(s, d).withColumn("kind", F.when(F.col("dataset.cases") % 2 == 0, F.col("kind")).otherwise("answer-evaluation"))
    r.write.option("maxRecordsPerFile", 1).json(f"{folder}/retrieval-runs.json")
    return eval_io.read_results(s, folder)


def _read_set(s, d):
    """Four datasets with a case for each benchmark item, some with faults of every kind, written as files and read back."""
    folder = f"{checkpoint_root(s)}/chronoweave/{s.sparkContext.applicationId}/sets-{uuid.uuid4().hex[:12]}"
    i = F.col("item_id")
    fact = lambda key, hours, value: F.struct(
        key.alias("key"), F.lit("credit_limit").alias("property"), value.cast("string").alias("value"), hours.alias("hours"), (i % 100).cast("int").alias("authority"),
        F.when(i % 2 == 0, "0.750").alias("confidence"), F.when(i % 3 == 0, "RESTRICTED").alias("privacy_scope"),
    )
    case = F.struct(
        F.concat(F.lit("c"), i.cast("string")).alias("id"), F.concat(F.lit("kind-"), (i % 3).cast("string")).alias("category"),
        F.when(i % 2 == 0, F.substring("text", 1, 40)).alias("question"), F.when(i % 2 == 1, F.upper(F.substring("text", 1, 20))).alias("query"),
        (i * 1.5).alias("valid_at_hours"), F.when(i % 4 == 0, "VIEWER").alias("caller_role"), F.array(F.lit("a")).alias("relevant"),
        F.create_map(F.when(i % 7 == 0, "a").otherwise("b"), F.lit("privacy")).alias("forbidden"),
        F.array(fact(F.lit("a"), i * 0.25, F.length("text")), fact(F.when(i % 13 == 0, "a").otherwise("b"), F.lit(None).cast("double"), i)).alias("facts"),
        F.struct(F.lit("answered").alias("status"), F.when(i % 5 == 0, F.array(F.lit("z"))).alias("cited_keys")).alias("expect"),
    )
    items = fx.table(s, d, "benchmark").select("item_id", "text")
    items = items.unionByName(items.where(i % 11 == 0))
    sets = items.groupBy((i % 4).alias("k")).agg(F.collect_list(case).alias("cases")).select(
        F.concat(F.lit("set-"), F.col("k").cast("string")).alias("name"), F.lit("1.0").alias("version"), F.lit(True).alias("synthetic"), "cases")
    sets.write.option("maxRecordsPerFile", 1).json(folder)
    return eval_io.read_eval_cases(s, folder)


_SET = """
it as (select * from benchmark union all select * from benchmark where item_id % 11 = 0),
fk as (select 'c' || item_id as case_id, 'a' as key, item_id as i, length(text) as value, item_id * 0.25 as hours from it
 union all select 'c' || item_id, case when item_id % 13 = 0 then 'a' else 'b' end, item_id, item_id, 0 from it)"""


def _exported(s, d, name):
    """Both analytics tables written as JSON lines by run date and read back through their schema."""
    folder = f"{checkpoint_root(s)}/chronoweave/{s.sparkContext.applicationId}/analytics-{uuid.uuid4().hex[:12]}"
    (eval_io.export_runs if name == "retrieval_runs" else eval_io.export_cases)(_results(s, d), folder)
    return s.read.schema(eval_io.ANALYTICS_SCHEMAS[name]).json(f"{folder}/{name}")


def _registered(s, d):
    """Both tables exported, registered as views and joined in SQL."""
    folder = f"{checkpoint_root(s)}/chronoweave/{s.sparkContext.applicationId}/analytics-{uuid.uuid4().hex[:12]}"
    results = _results(s, d)
    eval_io.export_runs(results, folder)
    eval_io.export_cases(results, folder)
    eval_io.register_analytics(s, folder)
    return flat(s.sql(
        "select r.run_date, r.configuration, count(distinct r.run_id) as runs, count(c.case_id) as cases, cast(sum(c.violation_count) as bigint) as violations "
        "from retrieval_runs r left join retrieval_cases c on c.run_id = r.run_id and c.configuration = r.configuration group by 1, 2"
    ))


_RUNS = """
rs as (select conv_id as i, count(*) as n, sum(length(text)) as chars from conversations group by 1),
runs as (select strftime(TIMESTAMP '2024-01-01' + INTERVAL '1' HOUR * (i % 720), '%Y-%m-%d') as run_date,
  strftime(TIMESTAMP '2024-01-01' + INTERVAL '1' HOUR * (i % 720), '%Y%m%dT%H%M%S') || '-' || substr(sha256(cast(i as varchar)), 1, 8) as run_id,
  strftime(TIMESTAMP '2024-01-01' + INTERVAL '1' HOUR * (i % 720), '%Y-%m-%dT%H:%M:%S') || '.5+00:00' as run_timestamp, sha256(cast(i as varchar)) as commit_sha,
  i % 3 = 0 as working_tree_dirty, i % 5 <> 0 as synthetic, c.name as configuration, n as cases, round(chars % 1000 / 1000.0::double, 4) as mrr,
  round(chars % 777 / 777.0::double, 4) as recall_at_5, round(chars % 555 / 555.0::double, 4) as ndcg_at_5 from rs, (values ('hybrid'), ('text_only')) c(name)),
tw as (select conv_id as i, turn, role, text, regexp_extract_all(lower(text), '[a-z]+') as ws from conversations),
tf as (select *, list_min(list_filter([list_position(ws, 'the'), list_position(ws, 'de'), list_position(ws, 'und')], lambda x: x > 0)) as first from tw),
cases as (select r.run_date, r.run_id, 'hybrid' as configuration, 'turn-' || lpad(cast(turn as varchar), 4, '0') as case_id, role as category, 3 as relevant_count, len(ws) as returned_count,
  first as first_relevant_rank, coalesce(round_even(1.0::double / first, 4), 0.0) as reciprocal_rank, length(text) * 0.25::double as latency_ms, len(list_filter(ws, lambda w: w = 'of')) as violation_count
 from tf join runs r on r.configuration = 'hybrid' and r.commit_sha = sha256(cast(tf.i as varchar)))"""


def _ar(body):
    return f"with {_RUNS.strip()}\n{body}"


QUERIES = {
    "ev1_outcomes": (
        lambda s, d: outcomes(s, d).select("configuration", "case_id", F.size("ranked_keys").alias("ranked"), F.size("relevant").alias("relevant"), F.size("violations").alias("violations")),
        sql(
            _EVAL + """
select configuration, question_id as case_id, cast((select count(*) from ranked r where r.configuration = pc.configuration and r.question_id = pc.question_id) as int) as ranked,
 rel as relevant, vt + va as violations from pc""", "led", "revs",
        ),
    ),
    "ev2_ev3_ev4_case_metrics": (
        _case_metrics,
        sql(
            _EVAL + """,
ideal as (select k, sum(1 / log2(g + 1)) as idcg from range(1, 4) r(k), range(1, 4) h(g) where g <= k group by 1)
select configuration, question_id as case_id, case when rel > 0 then round(coalesce(1.0::double / first, 0), 6) end as rr, case when rel > 0 then round(f3 / rel::double, 6) end as recall_at_3,
 case when rel > 0 then round(f10 / rel::double, 6) end as recall_at_10, case when rel > 0 then round(f5 / 5.0::double, 6) end as precision_at_5,
 case when rel > 0 then round(dcg3 / idcg, 6) end as ndcg_at_3, vt + va as violations from pc left join ideal on k = least(rel, 3)""", "led", "revs",
        ),
    ),
    "ev5_ev6_summary": (
        _summary,
        sql(
            _EVAL + """,
ideal as (select k, sum(1 / log2(g + 1)) as idcg from range(1, 4) r(k), range(1, 4) h(g) where g <= k group by 1)
select configuration, count(*) as cases, count(*) filter (rel > 0) as cases_with_relevant_facts, round(round(avg(case when rel > 0 then coalesce(1.0::double / first, 0) end), 4), 3) as mrr,
 round(round(avg(case when rel > 0 then f1 / rel::double end), 4), 3) as recall_at_1, round(round(avg(case when rel > 0 then f5 / rel::double end), 4), 3) as recall_at_5,
 round(round(avg(case when rel > 0 then f3 / 3.0::double end), 4), 3) as precision_at_3, round(round(avg(case when rel > 0 then dcg3 / idcg end), 4), 3) as ndcg_at_3,
 round(round(avg(case when tmp > 0 then case when vt = 0 then 1.0::double else 0 end end), 4), 3) as temporal_correctness,
 round(round(avg(case when auth > 0 then case when va = 0 then 1.0::double else 0 end end), 4), 3) as authorization_correctness,
 cast(sum(vt + va) as bigint) as forbidden_results, cast(list_sort(list(latency_ms))[count(*) // 2 + 1] as double) as latency_ms_p50 from pc left join ideal on k = least(rel, 3) group by 1""", "led", "revs",
        ),
    ),
    "ev7_summary_by_category": (
        lambda s, d: ev.summarize_by_category(outcomes(s, d)).withColumn("mrr", F.round("mrr", 3)).withColumn("recall_at_3", F.round("recall_at_3", 3)),
        sql(
            _EVAL + """
select configuration, category, count(*) as cases, round(round(avg(case when rel > 0 then coalesce(1.0::double / first, 0) end), 4), 3) as mrr,
 round(round(avg(case when rel > 0 then f3 / rel::double end), 4), 3) as recall_at_3, cast(sum(vt + va) as bigint) as forbidden_results from pc group by 1, 2""", "led", "revs",
        ),
    ),
    "ev8_configurations": (
        lambda s, d: _ranked(s, d).select("configuration", "case_id", F.array_join("ranked_keys", ",").alias("ranked")),
        sql(
            _EVAL + """
select pc.configuration, pc.question_id as case_id, coalesce(string_agg(cast(r.id as varchar), ',' order by r.position), '') as ranked from pc
 left join ranked r on r.configuration = pc.configuration and r.question_id = pc.question_id group by 1, 2""", "led", "revs",
        ),
    ),
    "ev9_ev12_accuracy_by_category": (
        lambda s, d: ev.accuracy_by_category(_answer_cases(s, d), ["prompt"]).withColumn("accuracy", F.round("accuracy", 3)),
        _ANSWERS.strip() + "\nselect prompt, category, count(*) as cases, round(round(avg(correct::int), 4), 3) as accuracy from k group by 1, 2",
    ),
    "ev10_pipeline_metrics": (
        _pipeline,
        _ANSWERS.strip() + """
select prompt, count(*) as cases, count(*) filter (called) as model_calls, round(round(avg((i % 11 <> 0 and i % 13 <> 0)::int), 4), 3) as context_correctness,
 round(round(avg((i % 11 <> 0)::int) filter (called and expected = 'answered'), 4), 3) as expected_facts_supplied, cast(sum(case when i % 13 = 0 then 2 else 0 end) as bigint) as forbidden_values_supplied from k group by 1""",
    ),
    "ev11_answer_metrics": (
        _answer_metrics,
        _ANSWERS.strip() + """,
p as (select prompt, list_sort(list(ms)) as ms, count(*) as n from k where called group by 1)
select k.prompt, round(round(avg(correct::int), 4), 3) as accuracy, round(round(avg(correct::int) filter (expected = 'answered'), 4), 3) as answered_case_accuracy,
 round(round(avg((status = 'insufficient_evidence')::int) filter (expected = 'insufficient_evidence'), 4), 3) as insufficient_evidence_accuracy,
 round(round(avg(correct::int) filter (category in ('temporal', 'superseded')), 4), 3) as temporal_correctness, round(round(avg((i % 4 = 0)::int) filter (called), 4), 3) as citation_validity,
 round(round(avg((i % 6 <> 1)::int) filter (status = 'answered' and expected = 'answered'), 4), 3) as citation_recall, round(round(avg((status = 'ungrounded')::int) filter (called), 4), 3) as ungrounded_rate,
 round(round(avg((i % 14 <> 0)::int) filter (called), 4), 3) as structured_output_validity, count(*) filter (status = 'error') as errors, round(avg(k.ms) filter (called), 2) as latency_ms_mean,
 cast(sum(i % 100) as bigint) as input_tokens, cast(sum(i % 40) as bigint) as output_tokens, round(sum(i % 100) / 1e6 * 3.0::double + sum(i % 40) / 1e6 * 15.0::double, 6) as estimated_cost_usd,
 any_value(p.ms[cast(ceil(0.5 * n) as int)]) as latency_ms_p50, any_value(p.ms[cast(ceil(0.95 * n) as int)]) as latency_ms_p95 from k join p using (prompt) group by 1""",
    ),
    "ev13_guard_rate": (
        _guard, "select round(avg((event_id % 33 <> 0)::int) filter (event_id % 3 = 0), 6) as guard_rate from events",
    ),
    "io6_registered_analytics": (
        _registered,
        _ar("""select r.run_date, r.configuration, count(distinct r.run_id) as runs, count(c.case_id) as cases, cast(sum(c.violation_count) as bigint) as violations
 from runs r left join cases c on c.run_id = r.run_id and c.configuration = r.configuration group by 1, 2"""),
    ),
    "io3_eval_cases": (
        lambda s, d: flat(_read_set(s, d)[0].select(
            "dataset_name", "case_id", "category", "query", "valid_at", "caller_role", F.array_join("relevant", ",").alias("relevant"),
            F.array_join(F.map_keys("forbidden"), ",").alias("forbidden"), "expected_status", F.array_join("cited_keys", ",").alias("cited_keys"))),
        f"""with {_SET.strip()}
select 'set-' || item_id % 4 as dataset_name, 'c' || item_id as case_id, 'kind-' || item_id % 3 as category, case when item_id % 2 = 0 then substr(text, 1, 40) else upper(substr(text, 1, 20)) end as query,
 strftime(TIMESTAMP '2026-01-15 09:00:00' + INTERVAL '1' MINUTE * (item_id * 90), '%Y-%m-%d %H:%M:%S.%f') as valid_at, case when item_id % 4 = 0 then 'VIEWER' else 'ADMIN' end as caller_role,
 'a' as relevant, case when item_id % 7 = 0 then 'a' else 'b' end as forbidden, 'answered' as expected_status, case when item_id % 5 = 0 then 'z' else '' end as cited_keys from it""",
    ),
    "io3_eval_facts": (
        lambda s, d: flat(_read_set(s, d)[1].select("case_id", "key", "property", "value", "valid_from", "entity_type", "external_id", "source", "authority", "confidence", "privacy_scope", "tenant", "revoked")),
        f"""with {_SET.strip()}
select case_id, key, 'credit_limit' as property, cast(value as varchar) as value, strftime(TIMESTAMP '2026-01-15 09:00:00' + INTERVAL '1' SECOND * cast(hours * 3600 as bigint), '%Y-%m-%d %H:%M:%S.%f') as valid_from,
 'customer' as entity_type, 'customer-991' as external_id, 'billing-db' as source, cast(i % 100 as int) as authority, case when i % 2 = 0 then 0.75 else 1.0 end::double as confidence,
 case when i % 3 = 0 then 'RESTRICTED' else 'INTERNAL' end as privacy_scope, 'self' as tenant, false as revoked from fk""",
    ),
    "io3_eval_problems": (
        lambda s, d: _read_set(s, d)[2].distinct(),
        f"""with {_SET.strip()}
select distinct 'duplicate_case_id' as problem, 'c' || item_id as case_id, null as key from benchmark where item_id % 11 = 0
union select 'duplicate_fact_key', case_id, key from fk group by 2, 3 having count(*) > 1
union select 'unknown_key', 'c' || item_id, 'z' from it where item_id % 5 = 0
union select 'unknown_key', 'c' || item_id, 'b' from it where item_id % 7 <> 0 and item_id % 13 = 0
union select 'relevant_and_forbidden', 'c' || item_id, 'a' from it where item_id % 7 = 0""",
    ),
    "io4_eval_results": (
        lambda s, d: flat(an.case_rows(_read_results(s, d)).select("run_id", "configuration", "case_id", "category", "relevant_count", "returned_count", "first_relevant_rank", "latency_ms", "violation_count")),
        _ar("select run_id, configuration, case_id, category, relevant_count, returned_count, first_relevant_rank, latency_ms, violation_count from cases where run_id in (select run_id from runs where cases % 2 = 0)"),
    ),
    "an1_run_rows": (
        lambda s, d: flat(_exported(s, d, "retrieval_runs").select("run_date", "run_id", "run_timestamp", "commit_sha", "working_tree_dirty", "synthetic", "configuration", "cases", "mrr", "recall_at_5", "ndcg_at_5")),
        _ar("select run_date, run_id, run_timestamp, commit_sha, working_tree_dirty, synthetic, configuration, cases, mrr, recall_at_5, ndcg_at_5 from runs"),
    ),
    "an2_case_rows": (
        lambda s, d: flat(_exported(s, d, "retrieval_cases").select("run_date", "run_id", "configuration", "case_id", "category", "relevant_count", "returned_count", "first_relevant_rank", "reciprocal_rank", "latency_ms", "violation_count")),
        _ar("select run_date, run_id, configuration, case_id, category, relevant_count, returned_count, first_relevant_rank, reciprocal_rank, latency_ms, violation_count from cases"),
    ),
    "an3_best_recall_at_5": (
        lambda s, d: flat(an.best_recall_at_5(_exported(s, d, "retrieval_runs"))),
        _ar("select run_date, run_id, configuration, recall_at_5, mrr, ndcg_at_5, synthetic from runs order by run_date desc, recall_at_5 desc, mrr desc limit 20"),
    ),
    "an4_mrr_by_category": (
        lambda s, d: an.mrr_by_category(_exported(s, d, "retrieval_cases")),
        _ar("select configuration, category, count(*) as cases, round(avg(reciprocal_rank), 4) as mrr, round(quantile_disc(latency_ms, 0.5), 2) as latency_ms_p50 from cases where relevant_count > 0 group by 1, 2"),
    ),
    "an5_correctness_violations": (
        lambda s, d: flat(an.correctness_violations(_exported(s, d, "retrieval_cases"))),
        _ar("select run_date, run_id, configuration, case_id, category, violation_count from cases where violation_count > 0"),
    ),
    "an6_trend_by_commit": (
        lambda s, d: an.trend_by_commit(_exported(s, d, "retrieval_runs")),
        _ar("select configuration, run_timestamp, substr(commit_sha, 1, 8) as commit_sha, working_tree_dirty, mrr, recall_at_5 from runs"),
    ),
    "an_contradictions_by_source": (
        lambda s, d: an.contradictions_by_source(conflicts(s, d), led(s, d)),
        sql(
            """with sides as (select organization_id, preferred_version_id, left_version_id as id from conf union all select organization_id, preferred_version_id, right_version_id from conf)
select s.organization_id, l.source_id, count(*) as contradictions, count(*) filter (s.preferred_version_id = s.id) as preferred from sides s join led l using (id) group by 1, 2""", "conf",
        ),
    ),
    "an_failed_runs_by_agent": (
        lambda s, d: an.failed_runs_by_agent(_runs(s, d)),
        "select conv_id % 4 as organization_id, 'investigator' as agent, count(*) as runs, count(*) filter (conv_id % 6 = 0) as failed from (select distinct conv_id from conversations) c group by 1",
    ),
}
