"""Bitemporal questions over the version table.

A version is known at K when ``recorded_at <= K``; its end is known at K when
``valid_until_recorded_at <= K``. Within one fact, ``version``, ``valid_from`` and ``recorded_at``
grow together, so the only version that can be valid at T as known at K is the last one that has
both started by T and been recorded by K. That turns the bitemporal question into as-of ranks plus
an equality join, and no (question x version) pairs of a busy entity are ever enumerated.

Revoked versions are left out of ``facts_at``; history, timeline, changes and lineage keep them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.functions.frames import told_apart
from chronoweave.functions.privacy import scope_ordinal, visible
from chronoweave.operators.ordered import CHUNK_ROWS, HOT_ROWS, asof_ranks, chunked_scan
from chronoweave.session import cut_lineage

FACT = ["organization_id", "fact_id"]
ENTITY = ["organization_id", "entity_type", "external_id"]
#: Rows of the scan of facts by entity that one task gets, about.
SCAN_ROWS = 500_000


def valid_at(T: Column, K: Column | None = None) -> Column:
    """Valid at T as known at K (K missing or null: everything recorded so far)."""
    started = F.col("valid_from") <= T
    unended = F.col("valid_until").isNull() | (F.col("valid_until") > T)
    if K is None:
        return started & unended
    known = K.isNull() | (F.col("recorded_at") <= K)
    end_unknown = F.coalesce(F.col("valid_until_recorded_at") > K, F.lit(False))
    return known & started & (unended | end_unknown)


def not_revoked(versions: DataFrame, revocations: DataFrame | None, K: Column | None = None) -> DataFrame:
    """Drop versions with a revocation known at the literal instant K (any, when K is None)."""
    if revocations is None:
        return versions
    gone = revocations if K is None else revocations.where(F.col("revoked_at") <= K)
    gone = gone.select("organization_id", F.col("fact_version_id").alias("id"))
    return versions.join(gone, ["organization_id", "id"], "left_anti")


def as_known(df: DataFrame, K: Column | None) -> DataFrame:
    """Hide an end that was learned after K."""
    if K is None:
        return df
    later = F.coalesce(F.col("valid_until_recorded_at") > K, F.lit(False))
    return df.withColumn("valid_until", F.when(~later, F.col("valid_until"))).withColumn(
        "valid_until_recorded_at", F.when(~later, F.col("valid_until_recorded_at"))
    )


def facts_at_instant(
    versions: DataFrame, T: Column, K: Column | None = None, revocations: DataFrame | None = None
) -> DataFrame:
    """Every fact's version valid at one instant: a pushed-down filter and an anti-join."""
    live = versions.where(valid_at(T, K))
    return as_known(not_revoked(live, revocations, K), K)


def ambiguous(versions: DataFrame, T: Column, K: Column | None = None, revocations: DataFrame | None = None) -> DataFrame:
    """Facts with more than one valid version at the instant: an error report, never a choice."""
    return (
        facts_at_instant(versions, T, K, revocations)
        .groupBy(*FACT)
        .agg(F.count(F.lit(1)).alias("matches"), F.min("version").alias("first_version"), F.max("version").alias("last_version"))
        .where("matches > 1")
    )


def _entity_facts(versions: DataFrame) -> DataFrame:
    return versions.select(*ENTITY, "fact_id").distinct()


def facts_at(
    versions: DataFrame,
    asks: DataFrame,
    revocations: DataFrame | None = None,
    *,
    same_instant: bool = False,
    columns: Sequence[str] | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Bitemporal as-of join for a table of asks.

    ``asks``: ``ask_id, organization_id, entity_type, external_id, valid_at, known_at`` (``known_at``
    may be null). Returns ``ask_id, valid_at, known_at`` and the version columns as known then.
    ``same_instant=True`` promises ``known_at = valid_at`` for every ask; one as-of scan then does.
    ``columns``: the version columns wanted, all by default.
    """
    wanted = list(versions.columns if columns is None else columns)
    if same_instant:
        found = _facts_by_entity(versions, asks, revocations, wanted, hot_rows)
        if found is not None:
            return found
    probes = asks.select("ask_id", *ENTITY, "valid_at", "known_at").join(_entity_facts(versions), ENTITY)
    if same_instant:
        timed = versions.withColumn("__both", F.greatest("valid_from", "recorded_at"))
        ranked = asof_ranks(probes, timed, FACT, {"__v": ("valid_at", "__both")}, "version", hot_rows=hot_rows)
    else:
        times = {"__vt": ("valid_at", "valid_from"), "__vk": ("known_at", "recorded_at")}
        ranked = asof_ranks(probes, versions, FACT, times, "version", hot_rows=hot_rows)
        ranked = ranked.withColumn("__v", F.least("__vt", "__vk"))  # least() skips a null K
    candidate = ranked.where("__v > 0").select(
        "ask_id", "valid_at", "known_at", *FACT, F.col("__v").cast("int").alias("version")
    )
    found = candidate.join(versions, [*FACT, "version"])
    T, K = F.col("valid_at"), F.col("known_at")
    unended = F.col("valid_until").isNull() | (F.col("valid_until") > T)
    found = found.where(unended | F.coalesce(F.col("valid_until_recorded_at") > K, F.lit(False)))
    if revocations is not None:
        gone = revocations.select(
            "organization_id", F.col("fact_version_id").alias("id"), F.col("revoked_at").alias("__gone")
        )
        found = found.join(gone, ["organization_id", "id"], "left").where(
            F.col("__gone").isNull() | F.coalesce(F.col("__gone") > K, F.lit(False))
        ).drop("__gone")
    return as_known(found, K).select("ask_id", "valid_at", "known_at", *wanted)


def _by_entity(versions: DataFrame, asks: DataFrame, hot_rows: int) -> tuple[DataFrame, list[str], list[int]] | None:
    """Whether versions and asks can be laid out by entity: its facts, the columns to deal by, and the number of tasks in a list,
    which is empty where Spark's own will do. None for an entity with more than ``hot_rows`` rows to scan, or a fact of several entities."""
    counted = versions.where(F.col("fact_id").isNotNull()).groupBy(*ENTITY, "fact_id").agg(F.count(F.lit(1)).alias("__n"))
    facts = cut_lineage(counted)
    if not facts.groupBy(*FACT).agg(F.count(F.lit(1)).alias("__of")).where("__of > 1").isEmpty():
        return None
    held = facts.groupBy(*ENTITY).agg(F.sum("__n").alias("__n"), F.count(F.lit(1)).alias("__facts"))
    asked = asks.groupBy(*ENTITY).agg(F.count(F.lit(1)).alias("__asks"))
    rows_of = F.col("__n") + F.col("__facts") * F.coalesce("__asks", F.lit(0))
    scanned = held.join(asked, ENTITY, "left").agg(F.max(rows_of).alias("most"), F.sum(rows_of).alias("every")).first()
    if (scanned["most"] or 0) > hot_rows:
        return None
    # a few bytes of asks become many rows: the number of tasks follows the rows, so that what one task sorts stays in memory
    tasks = math.ceil((scanned["every"] or 0) / SCAN_ROWS)
    place = ["organization_id", "external_id"]  # as the asks' join: the type is mostly one literal, which no shuffle keeps as a key
    more = tasks > int(versions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return facts, place, [tasks] if more else []


def _facts_by_entity(
    versions: DataFrame, asks: DataFrame, revocations: DataFrame | None, wanted: list[str], hot_rows: int
) -> DataFrame | None:
    """:func:`facts_at` with one instant an ask, laid out by entity: versions and asks are shuffled by it once, each as one row, and all
    that follows (the asks by fact, the scan, a ranking of an ask's facts) stays there. A version travels through the scan
    with its ask, so it is not looked up again.

    None where that does not hold: an entity with more than ``hot_rows`` rows to scan, or a fact of several entities.
    """
    layout = _by_entity(versions, asks, hot_rows)
    if layout is None:
        return None
    facts, place, tasks = layout
    dealt = lambda df: df.repartition(*tasks, *place) if tasks else df

    rows = versions.withColumn("__gone", F.lit(None).cast("timestamp"))
    if revocations is not None:
        gone = revocations.select("organization_id", F.col("fact_version_id").alias("id"), F.col("revoked_at").alias("__gone"))
        rows = versions.join(gone, ["organization_id", "id"], "left")
    key = [*ENTITY, "fact_id"]
    own = [c for c in dict.fromkeys([*wanted, "valid_until", "valid_until_recorded_at", "__gone"]) if c not in key]
    marks = (
        rows.select(*key, F.col("version").alias("__version"), F.greatest("valid_from", "recorded_at").alias("__t"), F.struct(*own).alias("__row"))
        .dropna(subset=[*key, "__version"])
        .repartition(*tasks, *place)
        .groupBy(*key, "__version")
        .agg(F.min("__t").alias("__t"), F.collect_list("__row").alias("__rows"))  # one row, unless a version comes twice
        .where(F.col("__t").isNotNull())
        .select(*key, "__t", F.lit(0).alias("__kind"), F.struct(F.col("__version").cast("long").alias("place"), F.col("__rows").alias("rows")).alias("__mark"))
    )
    none = F.lit(None).cast(marks.schema["__mark"].dataType).alias("__mark")
    probes = (  # not broadcast: the asks by fact would have to be shuffled for the scan, several times as many rows
        dealt(asks.where(F.col("valid_at").isNotNull()).select("ask_id", *ENTITY, "valid_at", "known_at"))
        .join(dealt(facts.select(*key)).hint("merge"), ENTITY)
        .select(*key, F.col("valid_at").alias("__t"), F.lit(1).alias("__kind"), none, "ask_id", "known_at")
    )
    upto = W.partitionBy(*key).orderBy("__t", "__kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = probes.unionByName(marks, allowMissingColumns=True).withColumn("__last", F.max("__mark").over(upto))
    found = last.where("__kind = 1 and __last.place > 0").select(
        "ask_id", F.col("__t").alias("valid_at"), "known_at", *key, F.explode("__last.rows").alias("__row")
    )
    found = found.select("ask_id", "valid_at", "known_at", *key, "__row.*")
    T, K = F.col("valid_at"), F.col("known_at")
    unended = F.col("valid_until").isNull() | (F.col("valid_until") > T)
    found = found.where(unended | F.coalesce(F.col("valid_until_recorded_at") > K, F.lit(False)))
    found = found.where(F.col("__gone").isNull() | F.coalesce(F.col("__gone") > K, F.lit(False)))
    return as_known(found, K).select("ask_id", "valid_at", "known_at", *wanted)


def history(versions: DataFrame, asks: DataFrame) -> DataFrame:
    """All versions of each asked fact known at K, as they looked then (revocations ignored).

    ``asks``: ``ask_id, organization_id, fact_id, known_at``.
    """
    K = F.col("known_at")
    rows = asks.select("ask_id", *FACT, "known_at").join(versions, FACT)
    return as_known(rows.where(K.isNull() | (F.col("recorded_at") <= K)), K)


def timeline(versions: DataFrame, asks: DataFrame) -> DataFrame:
    """Every version of every fact of each asked entity, known at K.

    Order for display: valid_from, property, version.
    """
    K = F.col("known_at")
    rows = asks.select("ask_id", *ENTITY, "known_at").join(versions, ENTITY)
    return as_known(rows.where(K.isNull() | (F.col("recorded_at") <= K)), K)


def changes_between(versions: DataFrame, asks: DataFrame, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Per ask and fact: the version before, the version after and how many took effect between.

    ``asks``: ``ask_id, organization_id, entity_type, external_id, start_at, end_at, known_at``.
    Facts without a change are left out. Versions ``first_transition..last_transition`` took effect
    in (start, end]; ``transitions_of`` lists them.
    """
    asked = asks.where(F.col("end_at") > F.col("start_at")).select("ask_id", *ENTITY, "start_at", "end_at", "known_at")
    r = _ends_by_entity(versions, asked, hot_rows)
    if r is None:
        r = _ends_by_fact(versions, asked, hot_rows)
    r = r.withColumn("transitions", F.col("__b") - F.col("__a"))
    changed = ~F.col("before_id").eqNullSafe(F.col("after_id")) | (F.col("transitions") > 0)
    return r.where(changed).select(
        "ask_id",
        *ENTITY,
        "fact_id",
        "start_at",
        "end_at",
        "known_at",
        "before_id",
        "before_version",
        "before_scope",
        "after_id",
        "after_version",
        "after_scope",
        "transitions",
        F.when(F.col("transitions") > 0, (F.col("__a") + 1).cast("int")).alias("first_transition"),
        F.when(F.col("transitions") > 0, F.col("__b").cast("int")).alias("last_transition"),
    )


def _alive(mark: dict[str, Column], instant: str) -> Column:
    """The version at a position counts as before or after only if it had not ended, as known at K."""
    ended_later = mark["valid_until"].isNull() | (mark["valid_until"] > F.col(instant))
    return mark["id"].isNotNull() & (ended_later | F.coalesce(mark["valid_until_recorded_at"] > F.col("known_at"), F.lit(False)))


def _ends_by_entity(versions: DataFrame, asked: DataFrame, hot_rows: int) -> DataFrame | None:
    """For each ask and fact of its entity the positions ``__a`` and ``__b`` of the last versions at start and end, as known at K, and
    ``before_`` and ``after_`` columns of those that had not ended then.

    Asks and versions are shuffled by entity once, each as one row, and scanned there in the order of either time; a version travels
    through the scan with its position, so it is not looked up again. None where they can't be laid out so, or where a position
    of a fact is null or comes twice.
    """
    layout = _by_entity(versions, asked, hot_rows)
    rows = versions.dropna(subset=ENTITY)
    if layout is None or not rows.where(F.col("fact_id").isNull()).isEmpty() or not told_apart(rows, *FACT, "version"):
        return None
    facts, place, tasks = layout
    key = [*ENTITY, "fact_id"]
    shown = {"id": F.col("id"), "valid_until": F.col("valid_until"), "valid_until_recorded_at": F.col("valid_until_recorded_at"), "scope": scope_ordinal("privacy_scope")}
    mark = F.struct(F.col("version").cast("long").alias("place"), *[c.alias(n) for n, c in shown.items()])
    started, recorded = F.col("valid_from"), F.col("recorded_at")
    marks = rows.select(*key, started.alias("__start"), started.alias("__end"), recorded.alias("__known"), F.lit(0).alias("__kind"), mark.alias("__mark"))
    marks = marks.repartition(*tasks, *place)
    none = F.lit(None).cast(marks.schema["__mark"].dataType).alias("__mark")
    asked = asked.repartition(*tasks, *place).distinct()
    facts = facts.select(*key)
    probes = asked.join((facts.repartition(*tasks, *place) if tasks else facts).hint("merge"), ENTITY).select(
        *key, F.col("start_at").alias("__start"), F.col("end_at").alias("__end"), F.col("known_at").alias("__known"), F.lit(1).alias("__kind"), none, "ask_id"
    )
    both = probes.unionByName(marks, allowMissingColumns=True)
    for at in ("__known", "__start", "__end"):
        upto = W.partitionBy(*key).orderBy(at, "__kind").rowsBetween(W.unboundedPreceding, W.currentRow)
        both = both.withColumn(f"__at{at}", F.max(F.when(F.col(at).isNotNull(), F.col("__mark"))).over(upto))
    found = both.where("__kind = 1").withColumnsRenamed({"__start": "start_at", "__end": "end_at", "__known": "known_at"})
    known = F.when(F.col("known_at").isNotNull(), F.coalesce("__at__known.place", F.lit(0).cast("long")))
    out = []
    for name, position, at, instant in (("before", "__a", "__at__start", "start_at"), ("after", "__b", "__at__end", "end_at")):
        there = F.coalesce(f"{at}.place", F.lit(0).cast("long"))
        last = {c: F.when(known < there, F.col(f"__at__known.{c}")).otherwise(F.col(f"{at}.{c}")) for c in shown}
        alive, least = _alive(last, instant), F.least(there, known)  # least() skips a null K
        out += [least.alias(position), F.when(alive, last["id"]).alias(f"{name}_id"), F.when(alive, least.cast("int")).alias(f"{name}_version"), F.when(alive, last["scope"]).alias(f"{name}_scope")]
    return found.select("ask_id", *key, "start_at", "end_at", "known_at", *out)


def _ends_by_fact(versions: DataFrame, asked: DataFrame, hot_rows: int) -> DataFrame:
    """The same where an entity or a fact is hot, or a fact belongs to several entities: laid out by fact, versions looked up by position."""
    probes = asked.join(_entity_facts(versions), ENTITY)
    times = {
        "__v1": ("start_at", "valid_from"), "__v2": ("end_at", "valid_from"), "__vk": ("known_at", "recorded_at")
    }
    r = asof_ranks(probes, versions, FACT, times, "version", hot_rows=hot_rows)
    r = r.withColumn("__a", F.least("__v1", "__vk")).withColumn("__b", F.least("__v2", "__vk"))
    ends = versions.select(
        *FACT, "version", F.col("id"), "valid_until", "valid_until_recorded_at", "privacy_scope"
    )

    def attach(df: DataFrame, pos: str, instant: str, name: str) -> DataFrame:
        side = ends.select(
            *FACT,
            F.col("version").cast("long").alias(pos),
            F.col("id").alias("__id"),
            F.col("valid_until").alias("__end"),
            F.col("valid_until_recorded_at").alias("__learned"),
            scope_ordinal("privacy_scope").alias("__scope"),
        )
        j = df.join(side, [*FACT, pos], "left")
        alive = _alive({"id": F.col("__id"), "valid_until": F.col("__end"), "valid_until_recorded_at": F.col("__learned")}, instant)
        return (
            j.withColumn(f"{name}_id", F.when(alive, F.col("__id")))
            .withColumn(f"{name}_version", F.when(alive, F.col(pos).cast("int")))
            .withColumn(f"{name}_scope", F.when(alive, F.col("__scope")))
            .drop("__id", "__end", "__learned", "__scope")
        )

    return attach(attach(r, "__a", "start_at", "before"), "__b", "end_at", "after")


def transitions_of(versions: DataFrame, changes: DataFrame) -> DataFrame:
    """The versions that took effect in each change, one row each, as known at K."""
    wanted = changes.where("transitions > 0").select(
        "ask_id",
        "known_at",
        *FACT,
        F.explode(F.sequence("first_transition", "last_transition")).alias("version"),
    )
    return as_known(wanted.join(versions, [*FACT, "version"]), F.col("known_at"))


def hide_partial_changes(versions: DataFrame, changes: DataFrame, ceiling: str) -> DataFrame:
    """Drop a change when any version it mentions is above the ceiling.

    The last such version up to the end of a change says so: nothing in between is listed, and a change is looked up once.
    """
    seen = visible("privacy_scope", ceiling)
    limit = ["PUBLIC", "INTERNAL", "CONFIDENTIAL", "RESTRICTED"].index(ceiling)
    sides = (F.coalesce("before_scope", F.lit(0)) <= limit) & (F.coalesce("after_scope", F.lit(0)) <= limit)
    rows, at = versions.select(*FACT, "version", "privacy_scope"), F.floor(F.col("version") / F.lit(CHUNK_ROWS))
    placed = rows.dropna(subset=[*FACT, "version"])
    if told_apart(placed, *FACT, "version"):
        last = chunked_scan(placed, FACT, at, [F.col("version")], running_max={"__above": F.when(seen, None).otherwise(F.col("version"))})
        last = last.select(*FACT, F.col("version").cast("int").alias("last_transition"), "__above")
        ends = changes.where(sides).join(last, [*FACT, "last_transition"], "left")
        return ends.where(F.coalesce(F.col("__above") < F.col("first_transition"), F.lit(True))).select(*changes.columns)
    # a position that comes twice: a running count of the versions above the ceiling, at both ends
    counted = chunked_scan(rows, FACT, at, [F.col("version")], running_sum={"__above": F.when(seen, 0).otherwise(1)})
    upto = counted.select(*FACT, F.col("version").cast("int").alias("last_transition"), F.col("__above").alias("__upto"))
    before = counted.select(*FACT, (F.col("version") + 1).cast("int").alias("first_transition"), F.col("__above").alias("__before"))
    ends = changes.where(sides).join(upto, [*FACT, "last_transition"], "left").join(before, [*FACT, "first_transition"], "left")
    return ends.where(F.coalesce("__upto", F.lit(0)) == F.coalesce("__before", F.lit(0))).select(*changes.columns)


def latest_versions(versions: DataFrame) -> DataFrame:
    """The highest version of every fact (map-side combined)."""
    rest = [c for c in versions.columns if c not in (*FACT, "version")]
    return (
        versions.groupBy(*FACT)
        .agg(F.max(F.struct("version", *rest)).alias("__row"))
        .select(*FACT, "__row.*")
        .select(*versions.columns)
    )


def versions_of(versions: DataFrame, fact_ids: DataFrame) -> DataFrame:
    """Versions of the given facts of the same tenant."""
    return versions.join(fact_ids.select(*FACT), FACT, "left_semi")


def versions_by_id(versions: DataFrame, ids: DataFrame) -> DataFrame:
    return versions.join(ids.select("organization_id", "id"), ["organization_id", "id"], "left_semi")


def lineage_summary(versions: DataFrame) -> DataFrame:
    """Where every version stands in its chain: counts, first successor, any hidden member.

    One aggregate per fact and one self equality join; the pairs of a chain are not listed.
    """
    chain = versions.groupBy(*FACT).agg(
        F.max("version").alias("__last"), F.max(scope_ordinal("privacy_scope")).alias("chain_scope")
    )
    successor = versions.select(
        *FACT, (F.col("version") - 1).alias("version"), F.col("id").alias("superseded_by")
    )
    return (
        versions.join(chain, FACT)
        .join(successor, [*FACT, "version"], "left")
        .select(
            *FACT,
            "id",
            "version",
            "supersedes_id",
            "superseded_by",
            (F.col("version") - 1).alias("ancestors"),
            (F.col("__last") - F.col("version")).alias("descendants"),
            "chain_scope",
        )
    )


def lineage(versions: DataFrame, version_ids: DataFrame) -> DataFrame:
    """Ancestors and descendants of the requested versions, one row each, oldest first by version.

    The output lists each requested chain once per request, so request few versions of a fact.
    """
    asked = version_ids.select("organization_id", F.col("id").alias("subject_id"))
    subject = asked.join(
        versions.select("organization_id", F.col("id").alias("subject_id"), "fact_id", F.col("version").alias("__v")),
        ["organization_id", "subject_id"],
    )
    other = subject.join(versions, FACT).where(F.col("version") != F.col("__v"))
    role = F.when(F.col("version") < F.col("__v"), "ancestor").otherwise("descendant")
    return other.withColumn("role", role).withColumn(
        "superseded_by", F.col("version") == F.col("__v") + 1
    ).drop("__v")


def hide_partial_lineage(lineage_rows: DataFrame, versions: DataFrame, ceiling: str) -> DataFrame:
    """Drop the whole chain of a subject when any version of it is above the ceiling."""
    hidden = versions.where(~visible("privacy_scope", ceiling)).select(*FACT).distinct()
    return lineage_rows.join(hidden, FACT, "left_anti")


def with_visibility(df: DataFrame, ceiling: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Visible rows, and per key how many were withheld."""
    seen = visible("privacy_scope", ceiling)
    counts = df.groupBy(*keys).agg(
        F.count_if(seen).alias("shown"), F.count_if(~seen).alias("withheld_by_privacy_scope")
    )
    return df.where(seen), counts
