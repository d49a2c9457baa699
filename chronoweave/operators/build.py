"""Building the ledger from claims: supersession, transaction time, closings, dimensions.

A claim is accepted when it starts at or after the *threshold* its fact has reached: the end of the
last accepted claim, or one microsecond after its start when it is open-ended. Accepting a claim
replaces the threshold by the claim's own.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions import scalars as sc
from chronoweave.functions.frames import computed_once
from chronoweave.functions.privacy import PRIVACY_ORDER
from chronoweave.operators.ordered import (
    CHUNK_ROWS,
    HOT_ROWS,
    HotKeys,
    chunked_scan,
    first_per_key,
    hot_keys,
    number_and_time,
    time_chunk,
    with_neighbours,
)
from chronoweave.session import cut_lineage

FACT = ["organization_id", "fact_id"]
_LOW = -(2**62)

# Kinds of sources.
SOURCE_TYPES = ("SYSTEM_OF_RECORD", "API", "DOCUMENT", "HUMAN", "AGENT")


@dataclass
class Built:
    versions: DataFrame  # logical: closings by later claims of this batch applied
    closures: DataFrame  # append-only closings, including those of earlier heads
    rejects: DataFrame  # id, reason


def assign_recorded_at(
    df: DataFrame,
    order: list[Column],
    *,
    arrival: str = "arrival",
    number: str = "version",
    chunk: Column | None = None,
    floor_us: Column | None = None,
    hot_rows: int = HOT_ROWS,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Number each fact's accepted claims and give them their transaction time ``recorded_at``."""
    return number_and_time(
        df,
        FACT,
        time_chunk(F.col(arrival)) if chunk is None else chunk,
        order,
        arrival=arrival,
        number=number,
        out="recorded_at",
        floor_us=floor_us,
        hot_rows=hot_rows,
        hot=hot,
    )


# --- the fold for facts that mix fixed ends and refused claims -------------------------------


def _outcomes(starts: list[int], ends: list[int]) -> tuple[list[int], list[int]]:
    """What a run of claims turns an incoming threshold into.

    Returns ascending ``bounds`` and ``outs``: a threshold up to ``bounds[i]`` (and above the bound
    before) leaves as ``outs[i]``; one above every bound leaves unchanged.
    """
    out = [0] * len(starts)
    stack: list[int] = []  # indexes ahead of i, nearest last, starts growing towards the front
    keys: list[int] = []  # negated starts, ascending, for bisect
    for i in range(len(starts) - 1, -1, -1):
        cut = bisect.bisect_right(keys, -ends[i])
        out[i] = out[stack[cut - 1]] if cut else ends[i]
        while stack and starts[stack[-1]] <= starts[i]:
            stack.pop()
            keys.pop()
        stack.append(i)
        keys.append(-starts[i])
    bounds: list[int] = []
    outs: list[int] = []
    for i in reversed(stack):
        if outs and outs[-1] == out[i]:
            bounds[-1] = starts[i]
        else:
            bounds.append(starts[i])
            outs.append(out[i])
    return bounds, outs


def _chunk_outcomes(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("__n")
    bounds, outs = _outcomes(pdf["__s"].tolist(), pdf["__e"].tolist())
    first = pdf.iloc[0]
    return pd.DataFrame(
        {
            "__fact": [first["__fact"]],
            "__k": [int(first["__k"])],
            "__head": [int(first["__head"])],
            "__bounds": [bounds],
            "__outs": [outs],
        }
    )


def _thread_thresholds(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("__k")
    threshold = int(pdf["__head"].iloc[0])
    incoming = []
    for bounds, outs in zip(pdf["__bounds"], pdf["__outs"]):
        incoming.append(threshold)
        at = bisect.bisect_left(list(bounds), threshold)
        if at < len(bounds):
            threshold = int(outs[at])
    return pd.DataFrame({"__fact": pdf["__fact"], "__k": pdf["__k"], "__in": incoming})


def _fold_batches(batches):
    """Accept or refuse rows that arrive sorted by (fact, chunk, order)."""
    current, threshold = None, _LOW
    for pdf in batches:
        flags = []
        for fact, k, start, end, incoming in zip(
            pdf["__fact"], pdf["__k"], pdf["__s"], pdf["__e"], pdf["__in"]
        ):
            if (fact, k) != current:
                current, threshold = (fact, k), incoming
            accepted = start >= threshold
            if accepted:
                threshold = end
            flags.append(accepted)
        yield pd.DataFrame({"__fact": pdf["__fact"], "id": pdf["id"], "__ok": flags})


def _fold(rows: DataFrame, chunk_rows: int) -> DataFrame:
    """__fact, id, __ok for the facts that need the sequential rule; an id may stand in several tenants.

    Facts are cut into chunks. The effect of each chunk on a threshold is worked out in parallel
    as a short step function; stringing those together gives every chunk its incoming threshold.
    """
    rows = rows.withColumn("__k", F.floor((F.col("__n") - 1) / F.lit(chunk_rows)).cast("long"))
    long_facts = rows.where("__k > 0").select("__fact").distinct()
    effects = (
        rows.join(long_facts, "__fact", "left_semi")
        .groupBy("__fact", "__k")
        .applyInPandas(
            _chunk_outcomes,
            "__fact string, __k long, __head long, __bounds array<long>, __outs array<long>",
        )
    )
    incoming = effects.groupBy("__fact").applyInPandas(
        _thread_thresholds, "__fact string, __k long, __in long"
    )
    ready = rows.join(incoming, ["__fact", "__k"], "left").withColumn("__in", F.coalesce("__in", "__head"))
    id_type = rows.schema["id"].dataType.simpleString()
    return (
        ready.select("id", "__fact", "__k", "__n", "__s", "__e", "__in")
        .repartition("__fact", "__k")
        .sortWithinPartitions("__fact", "__k", "__n")
        .mapInPandas(_fold_batches, f"__fact string, id {id_type}, __ok boolean")
    )


def build_versions(
    claims: DataFrame,
    heads: DataFrame | None = None,
    known_evidence: DataFrame | None = None,
    *,
    hot_rows: int = HOT_ROWS,
    chunk_rows: int = CHUNK_ROWS,
) -> Built:
    """Plan versions from claims, per fact in arrival order (ties by id).

    ``claims``: the version columns without ``version, recorded_at, supersedes_id`` plus
    ``arrival``; optionally ``evidence_ids``. ``heads`` are the latest stored versions of the facts.
    """
    rejects = []

    def refuse(df: DataFrame, reason: str) -> None:
        rejects.append(df.select("organization_id", "id", F.lit(reason).alias("reason")))

    bad_window = F.col("valid_until").isNotNull() & (F.col("valid_until") <= F.col("valid_from"))
    refuse(claims.where(bad_window), "empty_window")
    usable = claims.where(~bad_window)
    if known_evidence is not None and "evidence_ids" in claims.columns:
        cited = usable.select("organization_id", "id", F.explode("evidence_ids").alias("evidence_id"))
        known = known_evidence.select("organization_id", F.col("id").alias("evidence_id"))
        broken = cited.join(known, ["organization_id", "evidence_id"], "left_anti").select("organization_id", "id").distinct()
        refuse(broken, "unknown_evidence")
        usable = usable.join(broken, ["organization_id", "id"], "left_anti")

    if heads is not None:
        h = heads.select(
            *FACT,
            F.col("version").alias("__hv"),
            F.col("id").alias("__hid"),
            F.col("valid_until").alias("__hend"),
            F.coalesce(F.unix_micros("valid_until"), F.unix_micros("valid_from") + 1).alias("__head"),
            F.unix_micros("recorded_at").alias("__hrec"),
        )
        usable = usable.join(h, FACT, "left")
    else:
        usable = usable.select(
            "*",
            F.lit(0).alias("__hv"),
            F.lit(None).cast(claims.schema["id"].dataType).alias("__hid"),
            F.lit(None).cast("timestamp").alias("__hend"),
            F.lit(None).cast("long").alias("__head"),
            F.lit(None).cast("long").alias("__hrec"),
        )
    usable = usable.withColumn("__head", F.coalesce("__head", F.lit(_LOW))).withColumn(
        "__hv", F.coalesce("__hv", F.lit(0))
    )
    start = F.unix_micros("valid_from")
    own = F.coalesce(F.unix_micros("valid_until"), start + 1)
    fixed = F.col("valid_until").isNotNull() | F.col("__hend").isNotNull()
    hot = hot_keys(usable, FACT, hot_rows)
    seen = chunked_scan(
        usable.withColumn("__s", start).withColumn("__e", own),
        FACT,
        time_chunk(F.col("arrival")),
        [F.col("arrival"), F.col("id")],
        number="__n",
        max_before={"__before": F.col("__e")},
        key_max={"__fixed": fixed},
        hot=hot,
    )
    seen = cut_lineage(seen)  # read for the fold's chunks and steps, and for both kinds of facts
    named = F.concat_ws("\u0000", F.col("organization_id").cast("string"), F.col("fact_id").cast("string")).alias("__fact")
    # Without fixed ends a refused claim never reaches past the accepted ones, so the running
    # maximum over all claims is the threshold. Facts with fixed ends take the sequential rule.
    fits = F.col("__s") >= F.greatest(F.coalesce("__before", F.lit(_LOW)), "__head")
    folded = _fold(
        seen.where("__fixed").select(
            "id",
            named,
            "__n",
            "__s",
            "__e",
            "__head",
        ),
        chunk_rows,
    )
    simple = seen.where(~F.col("__fixed")).withColumn("__ok", fits)
    judged = simple.unionByName(seen.where("__fixed").select("*", named).join(folded, ["__fact", "id"]).drop("__fact"))
    judged = cut_lineage(judged)  # three outputs and three scans start from here
    refuse(judged.where(~F.col("__ok")), "starts_before_latest_allows")

    timed = assign_recorded_at(
        judged.where("__ok"),
        [F.col("__n")],
        number="__i",
        chunk=F.floor((F.col("__n") - 1) / F.lit(CHUNK_ROWS)),
        floor_us=F.col("__hrec"),
        hot=hot,
    )
    linked = with_neighbours(
        timed,
        FACT,
        "__i",
        previous={"__prev": "id"},
        following={"__next_from": "valid_from", "__next_rec": "recorded_at"},
    )
    open_end = F.col("valid_until").isNull()
    keep = [c for c in claims.columns if c not in ("arrival", "evidence_ids", "valid_until")]
    versions = linked.select(
        *keep,
        (F.col("__hv") + F.col("__i")).cast("int").alias("version"),
        F.when(open_end, F.col("__next_from")).otherwise(F.col("valid_until")).alias("valid_until"),
        "recorded_at",
        F.when(open_end, F.col("__next_rec")).otherwise(F.col("recorded_at")).alias("valid_until_recorded_at"),
        F.coalesce("__prev", "__hid").alias("supersedes_id"),
    )
    closures = linked.where(open_end & F.col("__next_from").isNotNull()).select(
        "organization_id",
        F.col("id").alias("fact_version_id"),
        F.col("__next_from").alias("valid_until"),
        F.col("__next_rec").alias("recorded_at"),
    )
    closures = closures.unionByName(
        linked.where((F.col("__i") == 1) & F.col("__hid").isNotNull() & F.col("__hend").isNull()).select(
            "organization_id",
            F.col("__hid").alias("fact_version_id"),
            F.col("valid_from").alias("valid_until"),
            "recorded_at",
        )
    )
    refused = rejects[0]
    for more in rejects[1:]:
        refused = refused.unionByName(more)
    return Built(versions=versions, closures=closures, rejects=refused)


# --- claims before planning ------------------------------------------------------------------


def normalize_claims(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Normalise identifiers and values of whole claim tables; split off rejects with a reason."""
    c = computed_once(
        claims,
        {
            "entity_type": sc.normalize_identifier(F.col("entity_type")),
            "external_id": sc.normalize_external_id(F.col("external_id")),
            "property": sc.normalize_identifier(F.col("property")),
            "value": sc.canonical_json(F.col("value")),
            "confidence": sc.normalize_confidence(F.coalesce(F.col("confidence").cast("string"), F.lit("1.000"))),
            "privacy_scope": F.coalesce("privacy_scope", F.lit("INTERNAL")),
            "observed_at": F.coalesce("observed_at", "valid_from"),
        },
    )
    reason = (
        F.when(~sc.identifier_ok(F.col("entity_type")), "bad_entity_type")
        .when(~sc.external_id_ok(F.col("external_id")), "bad_external_id")
        .when(~sc.identifier_ok(F.col("property")), "bad_property")
        .when(~sc.fact_value_ok(F.col("value")), "bad_value")
        .when(F.col("valid_from").isNull(), "missing_valid_from")
        .when(F.col("valid_until") <= F.col("valid_from"), "empty_window")
        .when(~sc.confidence_ok(F.col("confidence")), "bad_confidence")
        .when(~F.col("privacy_scope").isin(*PRIVACY_ORDER), "bad_privacy_scope")
    )
    c = c.withColumn("reason", reason)
    return c.where(F.col("reason").isNull()).drop("reason"), c.where(F.col("reason").isNotNull())


def apply_claim_defaults(claims: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fill observed_at, authority (from the source), confidence and scope; reject unknown sources."""
    s = sources.select("organization_id", F.col("id").alias("source_id"), "default_authority")
    c = claims.join(s, ["organization_id", "source_id"], "left")
    filled = (
        c.withColumn("observed_at", F.coalesce("observed_at", "valid_from"))
        .withColumn("authority", F.coalesce("authority", "default_authority"))
        .withColumn("confidence", F.coalesce("confidence", F.lit("1.000").cast("decimal(4,3)")))
        .withColumn("privacy_scope", F.coalesce("privacy_scope", F.lit("INTERNAL")))
    )
    reason = F.when(F.col("default_authority").isNull(), "unknown_source").when(
        ~sc.authority_ok(F.col("authority")), "bad_authority"
    )
    filled = filled.withColumn("reason", reason).drop("default_authority")
    return filled.where(F.col("reason").isNull()).drop("reason"), filled.where(F.col("reason").isNotNull())


def _key_id(*parts: str) -> Column:
    return F.sha2(F.to_json(F.array(*[F.col(p).cast("string") for p in parts])), 256)


def upsert_dimensions(
    claims: DataFrame, entities: DataFrame | None = None, facts: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """New entities and facts of the claims; ids are a hash of the natural key, so writers agree."""
    entity_key = ["organization_id", "entity_type", "external_id"]
    new_entities = claims.select(*entity_key).distinct()
    new_facts = claims.select(*entity_key, "property").distinct()
    if entities is not None:
        new_entities = new_entities.join(entities, entity_key, "left_anti")
    if facts is not None:
        new_facts = new_facts.join(facts, [*entity_key, "property"], "left_anti")
    return (
        new_entities.withColumn("id", _key_id(*entity_key)),
        new_facts.withColumn("entity_id", _key_id(*entity_key)).withColumn("id", _key_id(*entity_key, "property")),
    )


def register_sources(requests: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted sources, and refused requests with a reason. First request of a name wins.

    ``requests``: ``organization_id, id, name, source_type, uri, default_authority, requested_at``.
    """
    r = requests.select(
        "organization_id",
        "id",
        sc.normalize_name(F.col("name")).alias("name"),
        "source_type",
        sc.normalize_uri(F.col("uri")).alias("uri"),
        F.coalesce("default_authority", F.lit(50)).alias("default_authority"),
        "requested_at",
    )
    reason = (
        F.when(~sc.name_ok(F.col("name")), "bad_name")
        .when(~F.col("source_type").isin(*SOURCE_TYPES), "bad_source_type")
        .when(~sc.uri_ok(F.col("uri")), "bad_uri")
        .when(~sc.authority_ok(F.col("default_authority")), "bad_authority")
    )
    r = r.withColumn("reason", reason)
    good = r.where(F.col("reason").isNull())
    key = ["organization_id", "name"]
    new = first_per_key(good.join(existing, key, "left_anti"), key, [F.col("requested_at"), F.col("id")])
    clash = good.join(new.select("organization_id", "id"), ["organization_id", "id"], "left_anti").withColumn(
        "reason", F.lit("name_exists")
    )
    refused = r.where(F.col("reason").isNotNull()).unionByName(clash)
    return new.drop("reason", "requested_at"), refused.select("organization_id", "id", "name", "reason")


# --- evidence --------------------------------------------------------------------------------


def capture_evidence(requests: DataFrame, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Store each distinct excerpt once per (tenant, source).

    Returns the new evidence rows, one outcome per accepted request (``evidence_id, created``) and
    the rejected requests. Only ids and hashes travel for the duplicate search; the excerpt of a
    winner is picked up afterwards.
    """
    excerpt = sc.normalize_excerpt(F.col("excerpt"))
    r = computed_once(
        requests,
        {"uri": sc.normalize_uri(F.col("uri")), "excerpt": excerpt, "content_sha256": sc.content_hash(excerpt)},
    )
    reason = F.coalesce(
        sc.excerpt_problem(F.col("excerpt")),
        F.when(~sc.uri_ok(F.col("uri")), "bad_uri"),
        F.when(~sc.metadata_ok(F.col("metadata")), "bad_metadata"),
    )
    r = r.withColumn("reason", reason)
    ok = r.where(F.col("reason").isNull()).drop("reason").withColumn("metadata", F.coalesce("metadata", F.lit("{}")))
    key = ["organization_id", "source_id", "content_sha256"]
    slim = cut_lineage(ok.select(*key, "id", "captured_at"))  # the texts are read once for their hashes
    winners = slim.groupBy(*key).agg(F.min(F.struct("captured_at", "id")).alias("__w")).select(
        *key, F.col("__w.id").alias("__winner")
    )
    if existing is not None:
        stored = existing.select(*key, F.col("id").alias("__stored"))
        winners = winners.join(stored, key, "left")
    else:
        winners = winners.withColumn("__stored", F.lit(None).cast(ok.schema["id"].dataType))
    outcome = slim.join(winners, key).select(
        *key,
        "id",
        F.coalesce("__stored", "__winner").alias("evidence_id"),
        (F.col("__stored").isNull() & (F.col("id") == F.col("__winner"))).alias("created"),
    )
    fresh = winners.where(F.col("__stored").isNull()).select("organization_id", F.col("__winner").alias("id"))
    evidence = ok.join(fresh, ["organization_id", "id"], "left_semi")
    return evidence, outcome, r.where(F.col("reason").isNotNull()).select("organization_id", "id", "reason")


def link_evidence(
    requests: DataFrame, versions: DataFrame, evidence: DataFrame, existing: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New links, conflicts (the pair is linked with the other relation) and links to unknown rows.

    Idempotent: a repeated link with the same relation is neither new nor a conflict.
    """
    v = versions.select("organization_id", F.col("id").alias("fact_version_id"), F.lit(True).alias("__v"))
    e = evidence.select("organization_id", F.col("id").alias("evidence_id"), F.lit(True).alias("__e"))
    pair = ["organization_id", "fact_version_id", "evidence_id"]
    r = requests.join(v, ["organization_id", "fact_version_id"], "left").join(e, ["organization_id", "evidence_id"], "left")
    is_known = F.col("__v").isNotNull() & F.col("__e").isNotNull()
    missing = r.where(~is_known).select(
        *pair, F.when(F.col("__v").isNull(), "unknown_version").otherwise("unknown_evidence").alias("reason")
    )
    known = r.where(is_known).select(*pair, "relation", "linked_at")
    if existing is not None:
        before = existing.select(*pair, F.col("relation").alias("__stored"))
        known = known.join(before, pair, "left")
    else:
        known = known.withColumn("__stored", F.lit(None).cast("string"))
    first = known.groupBy(*pair).agg(
        F.min(F.struct("linked_at", "relation")).alias("__f"), F.first("__stored").alias("__stored")
    )
    new = first.where(F.col("__stored").isNull()).select(*pair, "__f.relation", "__f.linked_at")
    kept = first.select(*pair, F.coalesce("__stored", "__f.relation").alias("__kept"))
    conflicts = known.join(kept, pair).where(F.col("relation") != F.col("__kept")).select(
        *pair, "relation", F.col("__kept").alias("linked_as")
    )
    return new, conflicts, missing
