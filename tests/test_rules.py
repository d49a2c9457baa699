"""Scalars, privacy, grounding, evaluation, audits and stored formats on small examples."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from chronoweave.functions import privacy as pv, scalars as sc
from chronoweave.ledger import SCHEMAS
from chronoweave.operators import access, analytics as an, audit as au, evaluation as ev, grounding as gr
from chronoweave.operators.contradictions import apply_resolutions
from chronoweave.sources import eval_io, ledger_io


def values(spark, items, *columns):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(items)], "i int, v string").select("i", *columns)
    return [tuple(r)[1:] for r in sorted(rows.collect())]


def test_identifiers(spark):
    n = sc.normalize_identifier(F.col("v"))
    got = values(spark, [" Credit_Limit ", "a.b_c.d9", "9a", "a..b", "", "a" * 129, "a b", None], n, sc.identifier_ok(n))
    assert [g[1] for g in got] == [True, True, False, False, False, False, False, False] and got[0][0] == "credit_limit"


def test_external_ids_slugs_emails_names(spark):
    x = sc.normalize_external_id(F.col("v"))
    assert [g[0] for g in values(spark, [" Kunde-é 1 ", "a​b", "a\x07", " ", "x" * 257], sc.external_id_ok(x))] == [True, False, False, False, False]
    s = sc.normalize_slug(F.col("v"))
    assert [g[0] for g in values(spark, ["Abc-1", "ab", "-abc", "abc-"], sc.slug_ok(s))] == [True, False, False, False]
    e = sc.normalize_email(F.col("v"))
    assert values(spark, [" A@B.org", "a b@c.d", "a@b"], e, sc.email_ok(e)) == [("a@b.org", True), ("a b@c.d", False), ("a@b", False)]
    m = sc.normalize_name(F.col("v"))
    assert values(spark, [" Ann \t  Lee ", "  "], m, sc.name_ok(m)) == [("Ann Lee", True), ("", False)]


def test_values_and_confidence(spark):
    c = sc.canonical_json(F.col("v"))
    got = values(spark, ['{"b": 1.0, "a": [true, "é"]}', "null", "{bad", "1e3", '"x"'], c, sc.fact_value_ok(c))
    assert [g[1] for g in got] == [True, False, False, True, True] and got[0][0] == '{"a":[true,"é"],"b":1}'
    big = json.dumps("é" * 2730)  # 6 bytes each when escaped, plus quotes: 16,382
    assert [g[0] for g in values(spark, [big, json.dumps("é" * 2731)], sc.fact_value_ok(c))] == [True, False]
    k = sc.normalize_confidence(F.col("v"))
    got = values(spark, ["0.1225", "0.1235", "1", "1.0005", "1.0006", "-0.1", "high"], k.cast("string"), sc.confidence_ok(k))
    assert got == [("0.122", True), ("0.124", True), ("1.000", True), ("1.000", True), ("1.001", False), ("-0.100", False), (None, False)]


def test_privacy(spark):
    df = spark.createDataFrame([("VIEWER", None), ("ENGINEER", "PUBLIC"), ("ADMIN", "CONFIDENTIAL"), ("VIEWER", "RESTRICTED")], "role string, cap string")
    assert [r[0] for r in df.select(pv.visible_ordinal(F.col("role"), F.col("cap"))).collect()] == [1, 0, 2, 1]
    hidden = access.redact(spark.createDataFrame([("PUBLIC", 1), ("RESTRICTED", 2)], "privacy_scope string, v int"), "INTERNAL", ["v"])
    assert [(r.redacted, r.v) for r in hidden.collect()] == [(False, 1), (True, None)]


def packed(spark):
    t = datetime(2024, 1, 1)
    rows = [("q", i, f"v{i}", "user", "u", "limit", json.dumps("x" * (600 if i == 2 else 3)), t, None, "crm", "API", 90, t) for i in (1, 2)]
    return gr.pack_facts(
        spark.createDataFrame(rows, "question_id string, position int, id string, entity_type string, external_id string, property string, value string, valid_from timestamp, valid_until timestamp, source_name string, source_type string, authority int, recorded_at timestamp")
        .withColumn("confidence", F.lit("0.900").cast("decimal(4,3)")).withColumn("fact_id", F.lit("f")).withColumn("source_id", F.lit("s"))
    )


def test_rendered_context(spark):
    asked = spark.createDataFrame([("q", "?"), ("none", "?")], "question_id string, query string")
    ctx = {r.question_id: r.context for r in gr.render_context(packed(spark), asked).collect()}
    lines = ctx["q"].split("\n")
    assert lines[0] == '[F1] user/u limit = "xxx" | valid 2024-01-01T00:00:00+00:00 to open-ended | source "crm" (API) | authority 90, confidence 0.900 | recorded 2024-01-01T00:00:00+00:00'
    assert '"' + "x" * 499 + "...(truncated)" in lines[1] and ctx["none"] == "(no facts)"


@pytest.mark.parametrize(
    "output,status,cited,rejected",
    [
        (dict(answer="a", insufficient_evidence=False, cited_facts=[" f2", "F1", "F2"]), "answered", ["F2", "F1"], []),
        (dict(answer="a", insufficient_evidence=False, cited_facts=["F1", "F9"]), "ungrounded", [], ["F9"]),
        (dict(answer="a", insufficient_evidence=False, cited_facts=[]), "ungrounded", [], []),
        (dict(answer=" ", insufficient_evidence=False, cited_facts=["F1"]), "ungrounded", [], []),
        (dict(answer="a", insufficient_evidence=True, cited_facts=["F1", "F9"]), "insufficient_evidence", [], ["F9"]),
        (dict(answer="a", insufficient_evidence="no", cited_facts=[]), "error", [], None),
        (dict(answer="a", insufficient_evidence=False), "error", [], None),
        (dict(answer="a", insufficient_evidence=False, cited_facts=["F1"], inferences=[1]), "error", [], None),
    ],
)
def test_citations(spark, output, status, cited, rejected):
    out = spark.createDataFrame([("q", json.dumps(output))], "question_id string, output string")
    row = gr.check_citations(gr.parse_answers(out), packed(spark)).first()
    assert (row.status, row.cited_labels, row.rejected_labels) == (status, cited, rejected)


def test_question_without_facts_needs_no_model(spark):
    asked = spark.createDataFrame([("empty", "who?")], "question_id string, query string")
    none = gr.check_citations(gr.parse_answers(spark.createDataFrame([], "question_id string, output string")), packed(spark))
    row = gr.assemble_answers(asked, none, packed(spark))[0].first()
    assert (row.status, row.model_called, row.grounded, row.facts_supplied) == ("insufficient_evidence", False, True, 0)


def test_answer_matching(spark):
    df = spark.createDataFrame([("It is $5,375.", ["5375"], ["2150"]), ("1,2,3", ["123"], []), ("Limit 2150 and 5375", ["5375"], ["2150"])], "answer string, contains array<string>, excludes array<string>")
    assert [r.answer_matches for r in gr.answer_matches(df).collect()] == [True, False, False]


def outcome_rows(spark):
    rows = [
        ("c", "a", "x", ["r1", "n", "r2"], ["r1", "r2"], {"bad": "revoked"}, 3.0), ("c", "b", "x", ["n", "bad"], ["r1"], {"bad": "privacy"}, 1.0),
        ("c", "d", "y", ["n"], [], {"old": "superseded"}, 2.0), ("c", "e", "y", ["old", "r1"], ["r1"], {"old": "superseded"}, 4.0),
    ]
    return spark.createDataFrame(rows, "configuration string, case_id string, category string, ranked_keys array<string>, relevant array<string>, forbidden map<string,string>, latency_ms double").withColumn(
        "violations", F.filter("ranked_keys", lambda k: F.map_contains_key(F.col("forbidden"), k))
    )


def test_retrieval_metrics(spark):
    m = {r.case_id: r for r in ev.case_metrics(outcome_rows(spark)).collect()}
    assert m["a"].rr == 1.0 and m["a"].recall_at_1 == 0.5 and m["a"].recall_at_3 == 1.0 and m["a"].precision_at_5 == 0.4
    assert m["a"].ndcg_at_3 == pytest.approx((1 + 1 / 2) / (1 + 0.6309297535714575))
    assert m["b"].rr == 0.0 and m["d"].rr is None and m["e"].rr == 0.5
    s = ev.summarize(outcome_rows(spark)).first()
    assert (s.cases, s.cases_with_relevant_facts, s.mrr, s.forbidden_results, s.latency_ms_p50) == (4, 3, 0.5, 2, 3.0)
    assert s.temporal_correctness == pytest.approx(0.6667) and s.authorization_correctness == 0.0


def test_three_configurations(spark):
    q = spark.createDataFrame([("q1", [1.0])], "question_id string, vector array<double>")
    rows = {r.configuration: r for r in ev.with_configurations(q).collect()}
    assert rows["hybrid"].trust_weight == 0.3 and rows["hybrid_no_trust"].trust_weight == 0.0 and rows["text_only"].vector is None
    assert rows["hybrid"].vector == [1.0] and len({r.question_id for r in rows.values()}) == 3


DATASET = {
    "name": "set", "version": "1", "synthetic": True, "description": "d",
    "cases": [
        {"id": "c1", "category": "temporal", "question": "?", "valid_at_hours": 1.5,
         "facts": [{"key": "k", "property": "p", "value": 1, "hours": 2}, {"key": "k", "property": "p", "value": "x"}],
         "expect": {"status": "answered", "cited_keys": ["k", "missing"]}},
        {"id": "c1", "category": "privacy", "query": "?", "facts": [{"key": "z", "property": "p", "value": True}], "relevant": ["z"], "forbidden": {"z": "privacy"}},
    ],
}


def test_dataset_reader_reports_problems(spark, tmp_path):
    (tmp_path / "set.json").write_text(json.dumps(DATASET))
    cases, facts, problems = eval_io.read_eval_cases(spark, str(tmp_path / "set.json"))
    assert cases.where("category = 'temporal'").first().valid_at == datetime(2026, 1, 15, 10, 30)
    first = facts.where("key = 'k'").orderBy("valid_from").collect()
    assert [f.valid_from for f in first] == [datetime(2026, 1, 15, 9), datetime(2026, 1, 15, 11)] and first[0].external_id == "customer-991"
    assert {(p.problem, p.key) for p in problems.collect()} == {
        ("duplicate_case_id", None), ("duplicate_fact_key", "k"), ("unknown_key", "missing"), ("relevant_and_forbidden", "z")
    }


def test_results_export_and_partition_pruning(spark, tmp_path):
    result = {
        "kind": "retrieval-evaluation", "date": "2026-09-25T00:55:49.123456+00:00", "commit_sha": "7c851db5aaaa", "dataset": {"name": "s", "version": "1"},
        "configuration": {"embedding_model": "m"}, "metrics": {"hybrid": {"cases": 2, "mrr": 0.75, "recall@5": 1.0, "by_category": {"x": {"mrr": 1}}}},
        "cases": {"hybrid": [{"case_id": "a", "category": "x", "ranked_keys": ["n", "r", "r2"], "relevant": ["r"], "latency_ms": 1.5, "vector_search": "used", "violations": ["n"]}]},
    }
    (tmp_path / "retrieval-1.json").write_text(json.dumps(result))
    (tmp_path / "retrieval-2.json").write_text(json.dumps({**result, "kind": "other"}))
    (tmp_path / "retrieval-3.json").write_text(json.dumps({**result, "date": "2026-09-26T00:00:00+00:00"}))
    results = eval_io.read_results(spark, str(tmp_path))
    assert results.count() == 2
    eval_io.export_runs(results, str(tmp_path / "out"))
    eval_io.export_cases(results, str(tmp_path / "out"))
    tables = eval_io.register_analytics(spark, str(tmp_path / "out"))
    run = tables["retrieval_runs"].orderBy("run_date").first()
    assert run.run_id == "20260925T005549-7c851db5" and run.recall_at_5 == 1.0 and run.synthetic and not run.working_tree_dirty and str(run.run_date) == "2026-09-25"
    case = tables["retrieval_cases"].orderBy("run_date").first()
    assert (case.first_relevant_rank, case.reciprocal_rank, case.relevant_count, case.violation_count) == (2, 0.5, 1, 1)
    one_day = tables["retrieval_cases"].where("run_date = date'2026-09-26'")
    assert one_day.count() == 1 and "PartitionFilters: [isnotnull(run_date" in one_day._jdf.queryExecution().executedPlan().toString()
    assert an.best_recall_at_5(tables["retrieval_runs"]).count() == 2
    assert len(tables["retrieval_runs"].columns) == 29 and len(tables["retrieval_cases"].columns) == 19


def test_audits_find_planted_faults(spark):
    t = lambda h: datetime(2024, 1, 1, h)
    rows = [
        ("o", "1", "f", 1, '"a"', t(1), t(5), t(1), t(3), None, 50, "PUBLIC"), ("o", "2", "f", 2, '"b"', t(4), None, t(3), None, "1", 50, "PUBLIC"),
        ("o", "3", "g", 1, "nope{", t(1), None, t(1), None, None, 200, "SECRET"), ("o", "4", "g", 1, "1", t(2), None, t(2), None, "1", 50, "PUBLIC"),
    ]
    df = spark.createDataFrame(rows, "organization_id string, id string, fact_id string, version int, value string, valid_from timestamp, valid_until timestamp, recorded_at timestamp, valid_until_recorded_at timestamp, supersedes_id string, authority int, privacy_scope string").withColumn("confidence", F.lit("1.000").cast("decimal(4,3)"))
    for hot in (1, 1_000_000):
        assert {r.key for r in au.overlapping_validity(df, hot_rows=hot).collect()} == {"o|2", "o|4"}
    assert {(r.rule, r.key) for r in au.version_numbering(df).collect()} == {
        ("duplicate_version", "o|g|1"), ("supersedes_missing_or_extra", "o|4"), ("superseded_twice", "o|1"), ("supersedes_other_fact", "o|4")
    }
    assert {(r.rule, r.key) for r in au.version_values(df).collect()} == {("bad_value", "o|3"), ("authority_out_of_range", "o|3"), ("unknown_scope", "o|3")}
    closed = df.withColumn("valid_until", F.when(F.col("id") == "4", F.lit(t(9))).otherwise(F.col("valid_until")))
    assert au.append_only(df, closed).count() == 0
    assert {r.rule for r in au.append_only(closed, df.where("id <> '1'")).collect()} == {"end_changed_twice", "version_vanished"}


def test_resolutions_close_once(spark):
    c = spark.createDataFrame([("o", "c1", "open", None, None, None)], "organization_id string, id string, status string, resolved_at timestamp, resolved_by_user_id string, resolution_note string")
    log = spark.createDataFrame([("o", "c1", 2, "dismissed", "late", "bob", datetime(2024, 1, 3)), ("o", "c1", 1, "resolved", "ok", "ann", datetime(2024, 1, 2)), ("o", "c9", 3, "resolved", "", "x", datetime(2024, 1, 1))],
                                "organization_id string, contradiction_id string, entry_id int, status string, note string, user_id string, at timestamp")
    now, refused = apply_resolutions(c, log)
    assert now.select("status", "resolved_by_user_id").first() == ("resolved", "ann")
    assert {(r.entry_id, r.problem) for r in refused.collect()} == {(2, "already_closed"), (3, "not_found")}


def test_stored_ledger_round_trip(spark, tmp_path):
    names = [c.split()[0] for c in SCHEMAS["versions"].split(", ")]
    row = dict.fromkeys(names)
    row.update(organization_id="o", id="1", fact_id="f", version=1, value="1", valid_from=datetime(2024, 1, 1), recorded_at=datetime(2024, 1, 1))
    df = spark.createDataFrame([tuple(row[n] for n in names)], SCHEMAS["versions"])
    ledger_io.append_versions(df, str(tmp_path))
    ledger_io.append_versions(df.withColumn("id", F.lit("2")).withColumn("version", F.lit(2)), str(tmp_path))
    closings = spark.createDataFrame([("o", "1", datetime(2024, 1, 5), datetime(2024, 1, 6)), ("o", "1", datetime(2024, 1, 7), datetime(2024, 1, 8))], "organization_id string, fact_version_id string, valid_until timestamp, recorded_at timestamp")
    ledger_io.append_closures(closings, str(tmp_path))
    loaded = {r.id: r.valid_until for r in ledger_io.load_ledger(spark, str(tmp_path), views=True).versions.collect()}
    assert loaded == {"1": datetime(2024, 1, 5), "2": None}  # the first closing wins
    assert spark.sql("select count(*) from versions").first()[0] == 2
