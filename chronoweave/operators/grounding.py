"""Checking batches of model outputs against the facts that were supplied. No model is called.

All facts a question is supplied with are rendered and can be cited; a search supplies at most 50.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions import scalars as sc

# Rendered contexts are stored and compared, so these texts, the length at which a value is cut, and the layout of
# a fact's line in fact_line() are what stored contexts have.
MAX_VALUE_CHARS = 500
TRUNCATED = "...(truncated)"
NO_FACTS = "(no facts)"
NO_FACTS_ANSWER = "No facts you are allowed to see match this question at that time."
ANSWER_SCHEMA = "answer string, insufficient_evidence boolean, cited_facts array<string>, inferences array<string>"


def pack_facts(results: DataFrame) -> DataFrame:
    """Search results with their label F1..Fn; ``position`` is the rank within the question."""
    return results.withColumn("label", F.concat(F.lit("F"), F.col("position").cast("string")))


def fact_line() -> Column:
    spaced = sc.display_json(sc.canonical_json(F.col("value")))
    value = F.when(
        F.length(spaced) > MAX_VALUE_CHARS, F.concat(F.substring(spaced, 1, MAX_VALUE_CHARS), F.lit(TRUNCATED))
    ).otherwise(spaced)
    return F.concat(
        F.lit("["), "label", F.lit("] "), "entity_type", F.lit("/"), "external_id", F.lit(" "), "property", F.lit(" = "), value,
        F.lit(" | valid "), sc.utc_iso(F.col("valid_from")), F.lit(" to "),
        F.coalesce(sc.utc_iso(F.col("valid_until")), F.lit("open-ended")),
        F.lit(" | source "), sc.json_string(F.coalesce("source_name", F.lit(""))), F.lit(" ("),
        F.coalesce("source_type", F.lit("")), F.lit(") | authority "), F.col("authority").cast("string"),
        F.lit(", confidence "), F.col("confidence").cast("string"), F.lit(" | recorded "), sc.utc_iso(F.col("recorded_at")),
    )


def render_context(packed: DataFrame, questions: DataFrame) -> DataFrame:
    """``question_id, context, facts_supplied``: one line per fact in rank order."""
    lines = (
        packed.select("question_id", "position", fact_line().alias("line"))
        .groupBy("question_id")
        .agg(F.array_sort(F.collect_list(F.struct("position", "line"))).alias("__l"))
        .select("question_id", F.array_join(F.col("__l.line"), "\n").alias("context"), F.size("__l").alias("facts_supplied"))
    )
    return questions.select("question_id").join(lines, "question_id", "left").select(
        "question_id", F.coalesce("context", F.lit(NO_FACTS)).alias("context"), F.coalesce("facts_supplied", F.lit(0)).alias("facts_supplied")
    )


def parse_answers(outputs: DataFrame) -> DataFrame:
    """``question_id, output`` -> parsed fields; ``error`` is set when the structure is malformed."""
    raw = F.try_parse_json("output")
    kind = lambda path: F.schema_of_variant(F.try_variant_get(raw, path, "variant"))
    is_text_list = lambda k: k.isin("ARRAY<STRING>", "ARRAY<VOID>")
    inferences = F.try_variant_get(raw, "$.inferences", "variant")
    good = (
        (kind("$.answer") == "STRING")
        & (kind("$.insufficient_evidence") == "BOOLEAN")
        & is_text_list(kind("$.cited_facts"))
        & (inferences.isNull() | is_text_list(kind("$.inferences")))
    )
    parsed = F.from_json("output", ANSWER_SCHEMA)
    fine = F.coalesce(good, F.lit(False))
    none = F.array().cast("array<string>")
    return outputs.select(
        "question_id",
        F.when(fine, sc.strip(parsed["answer"])).alias("answer"),
        F.when(fine, parsed["insufficient_evidence"]).alias("insufficient"),
        F.when(fine, F.transform(parsed["cited_facts"], sc.strip)).alias("cited"),
        F.when(fine, F.coalesce(parsed["inferences"], none)).alias("inferences"),
        F.when(~fine, "MalformedGenerationError").alias("error"),
    )


def check_citations(answers: DataFrame, packed: DataFrame) -> DataFrame:
    """Status of each parsed answer, its valid labels in the model's order, and the invented ones."""
    labels = packed.groupBy("question_id").agg(F.collect_set("label").alias("__labels"))
    a = answers.join(labels, "question_id", "left").withColumn(
        "__labels", F.coalesce("__labels", F.array().cast("array<string>"))
    )
    known = lambda x: F.array_contains(F.col("__labels"), F.upper(x))
    rejected = F.filter("cited", lambda x: ~known(x))
    valid = F.array_distinct(F.transform(F.filter("cited", known), F.upper))
    ungrounded = (F.size(rejected) > 0) | (F.size(valid) == 0) | (F.length("answer") == 0)
    status = (
        F.when(F.col("error").isNotNull(), "error")
        .when(F.col("insufficient"), "insufficient_evidence")
        .when(ungrounded, "ungrounded")
        .otherwise("answered")
    )
    a = a.withColumn("status", status).withColumn("rejected_labels", rejected)
    none = F.array().cast("array<string>")
    return a.withColumn("cited_labels", F.when(F.col("status") == "answered", valid).otherwise(none)).drop("__labels")


def assemble_answers(questions: DataFrame, checked: DataFrame, packed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per question, and its citations resolved to versions and sources."""
    supplied = packed.groupBy("question_id").agg(F.count(F.lit(1)).alias("facts_supplied"))
    q = questions.select("question_id", sc.collapse(F.col("query")).alias("question")).join(supplied, "question_id", "left")
    q = q.fillna(0, subset=["facts_supplied"]).join(checked, "question_id", "left")
    empty = F.col("facts_supplied") == 0
    status = F.when(empty, "insufficient_evidence").otherwise(F.coalesce("status", F.lit("error")))
    heads = q.select(
        "question_id", "question", status.alias("status"),
        F.when(empty, NO_FACTS_ANSWER).when(~status.isin("ungrounded", "error"), F.col("answer")).alias("answer"),
        (~status.isin("ungrounded", "error")).alias("grounded"),
        (~empty).alias("model_called"),
        F.when(status == "answered", F.col("inferences")).alias("inferences"),
        F.when(~empty, F.col("rejected_labels")).alias("rejected_labels"),
        "facts_supplied",
    )
    cited = checked.where(F.col("status") == "answered").select(
        "question_id", F.posexplode("cited_labels").alias("citation", "label")
    )
    citations = cited.join(packed, ["question_id", "label"]).select(
        "question_id", "citation", "label", F.col("id").alias("fact_version_id"), "fact_id", "source_id", "source_name",
        "entity_type", "external_id", "property", "valid_from", "valid_until",
    )
    return heads, citations


def check_investigations(runs: DataFrame) -> DataFrame:
    """Cited ids must have been observed by the run's own tool calls.

    ``runs``: ``run_id, answer, insufficient, cited_ids, observed_ids``.
    """
    rejected = F.filter("cited_ids", lambda x: ~F.array_contains(F.col("observed_ids"), x))
    kept = F.filter("cited_ids", lambda x: F.array_contains(F.col("observed_ids"), x))
    bad = (F.size(rejected) > 0) | (~F.col("insufficient") & (F.size(kept) == 0))
    status = F.when(bad, "ungrounded").when(F.col("insufficient"), "insufficient_evidence").otherwise("answered")
    return runs.select(
        "run_id", status.alias("status"), F.when(~bad, F.col("answer")).alias("answer"),
        kept.alias("cited_ids"), rejected.alias("rejected_ids"),
    )


def context_leaks(contexts: DataFrame) -> DataFrame:
    """Forbidden strings found in what was supplied (``context``, ``forbidden`` array), any case."""
    return contexts.withColumn(
        "leaks", F.filter("forbidden", lambda x: F.contains(F.lower("context"), F.lower(x)))
    )


def normalize_answer(c: Column) -> Column:
    """Lower case, thousands separators dropped."""
    return F.lower(F.regexp_replace(c, r"(?<=\d),(?=\d{3}\b)", ""))


def answer_matches(answers: DataFrame) -> DataFrame:
    """All of ``contains`` and none of ``excludes`` appear in the normalised answer."""
    text = normalize_answer(F.coalesce("answer", F.lit("")))
    return answers.withColumn(
        "answer_matches",
        F.forall("contains", lambda x: F.contains(text, F.lower(x))) & ~F.exists("excludes", lambda x: F.contains(text, F.lower(x))),
    )


def run_traces(runs: DataFrame, requests: DataFrame) -> DataFrame:
    """Stored runs of a requester in a tenant, one row per tool call (null tool: no call made)."""
    mine = runs.join(
        requests.select("organization_id", "requested_by_user_id"), ["organization_id", "requested_by_user_id"], "left_semi"
    )
    return mine.select(
        "organization_id", "requested_by_user_id", "run_id", "status", "steps",
        F.posexplode_outer("tool_calls").alias("call", "__t"),
    ).select(
        "organization_id", "requested_by_user_id", "run_id", "status", "steps", "call",
        "__t.tool", "__t.ok", "__t.error", "__t.latency_ms",
    )
