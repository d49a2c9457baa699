"""Order-dependent work per key that stays balanced when one key holds most of the rows.

A plain window partitioned by the key puts a hot key into one task. The helpers here first ask
which keys are hot (one narrow count, combined on the map side). Without any, a plain window is
used: one shuffle. Hot keys are split into chunks of their order; the window runs inside (key,
chunk), and one summary row per chunk carries over what came before it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.session import cut_lineage

# A key with more rows than this is split. Hence there are fewer than rows / HOT_ROWS hot keys,
# which bounds the size of every broadcast of hot keys.
HOT_ROWS = 1_000_000
CHUNK_ROWS = 4096

_CHUNK, _HOT = "__chunk", "__hot"


def time_chunk(ts: Column, seconds: int = 3600) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("long")


@dataclass(frozen=True)
class HotKeys:
    """The keys to split; ``frame`` is None when there is none."""

    frame: DataFrame | None


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> HotKeys:
    """Find the keys with more than ``hot_rows`` rows. Pass the result to every scan of these rows."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    hot = counts.where(F.col("__rows") > hot_rows).select(*keys, F.lit(True).alias(_HOT))
    if hot.isEmpty():
        return HotKeys(None)
    return HotKeys(cut_lineage(hot))


@dataclass(frozen=True)
class _Chunks:
    """How one scan is split: the rows with their chunk, and the rows whose chunks need a carry."""

    rows: DataFrame
    carried: DataFrame | None
    by: list[str]


def _split(df: DataFrame, keys: list[str], chunk: Column, hot: HotKeys) -> _Chunks:
    numbered = df.withColumn(_CHUNK, chunk.cast("long"))
    if not keys:  # the whole input is one group
        return _Chunks(numbered, numbered, [_CHUNK])
    if hot.frame is None:
        return _Chunks(df, None, keys)
    marked = df.join(F.broadcast(hot.frame), keys, "left").withColumn(
        _CHUNK, F.when(F.col(_HOT), chunk.cast("long")).otherwise(F.lit(0).cast("long"))
    )
    return _Chunks(marked.drop(_HOT), numbered.join(F.broadcast(hot.frame), keys, "left_semi"), [*keys, _CHUNK])


def chunked_scan(
    df: DataFrame,
    keys: Sequence[str],
    chunk: Column,
    order: Sequence[Column],
    *,
    number: str | None = None,
    running_max: Mapping[str, Column] | None = None,
    max_before: Mapping[str, Column] | None = None,
    running_sum: Mapping[str, Column] | None = None,
    key_max: Mapping[str, Column] | None = None,
    hot_rows: int = HOT_ROWS,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Row number, running maxima and running sums per key in the given order.

    ``max_before`` is a running maximum that leaves the current row out; ``key_max`` is the maximum
    over the whole key. ``chunk`` must be non-decreasing in ``order``. With no keys the whole input
    is one group and is always split by chunk.
    """
    keys = list(keys)
    before_max, whole, sums = dict(max_before or {}), dict(key_max or {}), dict(running_sum or {})
    maxima = {**(running_max or {}), **before_max, **whole}
    if hot is None:
        hot = hot_keys(df, keys, hot_rows) if keys else HotKeys(None)
    parts = _split(df, keys, chunk, hot)
    local = W.partitionBy(*parts.by).orderBy(*order)
    upto = local.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = parts.rows
    if number:
        rows = rows.withColumn("__n", F.row_number().over(local).cast("long"))
    for name, expr in maxima.items():
        frame = upto
        if name in before_max:
            frame = local.rowsBetween(W.unboundedPreceding, -1)
        elif name in whole:
            frame = W.partitionBy(*parts.by)
        rows = rows.withColumn(f"__max_{name}", F.max(expr).over(frame))
    for name, expr in sums.items():
        rows = rows.withColumn(f"__sum_{name}", F.sum(expr).over(upto))
    out = [F.col(c) for c in df.columns]
    if parts.carried is None:
        if number:
            out.append(F.col("__n").alias(number))
        out += [F.col(f"__max_{n}").alias(n) for n in maxima] + [F.col(f"__sum_{n}").alias(n) for n in sums]
        return rows.select(*out)

    totals = [F.count(F.lit(1)).alias("__c")]
    totals += [F.max(e).alias(f"__tmax_{n}") for n, e in maxima.items()]
    totals += [F.sum(e).alias(f"__tsum_{n}") for n, e in sums.items()]
    summary = parts.carried.groupBy(*keys, _CHUNK).agg(*totals)
    before = W.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(W.unboundedPreceding, -1)
    carry = summary.select(
        *keys,
        _CHUNK,
        F.sum("__c").over(before).alias("__cn"),
        *[
            F.max(f"__tmax_{n}").over(W.partitionBy(*keys) if n in whole else before).alias(f"__cmax_{n}")
            for n in maxima
        ],
        *[F.sum(f"__tsum_{n}").over(before).alias(f"__csum_{n}") for n in sums],
    )
    joined = rows.join(carry, [*keys, _CHUNK], "left")
    if number:
        out.append((F.col("__n") + F.coalesce("__cn", F.lit(0))).alias(number))
    out += [F.greatest(f"__max_{n}", f"__cmax_{n}").alias(n) for n in maxima]
    for name in sums:
        some = F.col(f"__sum_{name}").isNotNull() | F.col(f"__csum_{name}").isNotNull()
        both = F.coalesce(f"__sum_{name}", F.lit(0)) + F.coalesce(f"__csum_{name}", F.lit(0))
        out.append(F.when(some, both).alias(name))
    return joined.select(*out)


def number_and_time(
    df: DataFrame,
    keys: Sequence[str],
    chunk: Column,
    order: Sequence[Column],
    *,
    arrival: str,
    number: str,
    out: str,
    floor_us: Column | None = None,
    hot_rows: int = HOT_ROWS,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Number the rows of each key and give each a strictly increasing time, in one scan.

    The time is ``arrival``, pushed so that it is at least one microsecond after the row before it:
    max over the rows so far of (arrival - n), plus n. ``floor_us`` is a time all rows must exceed.
    """
    keys = list(keys)
    at = F.unix_micros(arrival)
    parts = _split(df, keys, chunk, hot_keys(df, keys, hot_rows) if hot is None else hot)
    local = W.partitionBy(*parts.by).orderBy(*order)
    upto = local.rowsBetween(W.unboundedPreceding, W.currentRow)

    def scan(rows: DataFrame) -> DataFrame:
        numbered = rows.withColumn("__n", F.row_number().over(local).cast("long"))
        return numbered.withColumn("__lead", F.max(at - F.col("__n")).over(upto))

    rows = scan(parts.rows)
    if parts.carried is None:
        rows = rows.withColumn("__cn", F.lit(0).cast("long")).withColumn("__cm", F.lit(None).cast("long"))
    else:
        summary = scan(parts.carried).groupBy(*keys, _CHUNK).agg(F.max("__n").alias("__c"), F.max("__lead").alias("__m"))
        before = W.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(W.unboundedPreceding, -1)
        counted = summary.withColumn("__cn", F.coalesce(F.sum("__c").over(before), F.lit(0)))
        carry = counted.withColumn("__cm", F.max(F.col("__m") - F.col("__cn")).over(before)).select(
            *keys, _CHUNK, "__cn", "__cm"
        )
        rows = rows.join(carry, [*keys, _CHUNK], "left").withColumn("__cn", F.coalesce("__cn", F.lit(0)))
    n = F.col("__n") + F.col("__cn")
    best = [F.col("__lead") - F.col("__cn"), F.col("__cm")]
    if floor_us is not None:
        best.append(floor_us)
    return rows.select(*df.columns, n.alias(number), F.timestamp_micros(F.greatest(*best) + n).alias(out))


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    *,
    previous: Mapping[str, Column | str] | None = None,
    following: Mapping[str, Column | str] | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Values of the row before and after, where ``position`` numbers each key's rows 1, 2, 3...

    Rows are shuffled once by (key, block of positions); the two rows at a block edge are sent to
    both blocks, so no task ever sees more than ``chunk_rows`` + 2 rows of a key.
    """
    pos = F.col(position).cast("long")
    home = F.floor((pos - 1) / F.lit(chunk_rows)).cast("long")
    left = F.floor((pos - 2) / F.lit(chunk_rows)).cast("long")
    right = F.floor(pos / F.lit(chunk_rows)).cast("long")
    spread = df.withColumn("__home", home).withColumn(
        "__block", F.explode(F.array_distinct(F.array(home, F.greatest(left, F.lit(0)), right)))
    )
    w = W.partitionBy(*keys, "__block").orderBy(position)
    for name, source in (previous or {}).items():
        spread = spread.withColumn(name, F.lag(source).over(w))
    for name, source in (following or {}).items():
        spread = spread.withColumn(name, F.lead(source).over(w))
    return spread.where(F.col("__home") == F.col("__block")).drop("__home", "__block")


def asof_ranks(
    probes: DataFrame,
    versions: DataFrame,
    keys: Sequence[str],
    times: Mapping[str, tuple[str, str]],
    position: str,
    *,
    chunk_seconds: int = 3600,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """For each probe and each ``out: (probe_time, version_time)`` of ``times``, the highest
    ``position`` of its key with ``version_time`` <= ``probe_time``.

    All probes and versions are laid out on one timeline per (key, version_time) and scanned once
    in time order, so the cost is linear in probes plus versions however many share a key. A null
    probe time gives null, one before every version gives 0. Probes must be distinct rows.
    """
    lines = {column: n for n, column in enumerate(dict.fromkeys(v for _, v in times.values()))}
    probe_type = probes.select(F.struct(*probes.columns).alias("s")).schema["s"].dataType
    marks = versions.select(
        *keys,
        F.inline(F.array(*[F.struct(F.lit(n).alias("__line"), F.col(c).alias("__t")) for c, n in lines.items()])),
        F.col(position).cast("long").alias("__pos"),
    ).select(
        *keys, "__line", "__t", F.lit(0).alias("__kind"), "__pos", F.lit(None).cast("string").alias("__out"),
        F.lit(None).cast(probe_type).alias("__probe"),
    )
    asked = probes.select(
        *keys,
        F.inline(
            F.array(*[
                F.struct(F.lit(lines[v]).alias("__line"), F.col(p).alias("__t"), F.lit(out).alias("__out"))
                for out, (p, v) in times.items()
            ])
        ),
        F.struct(*probes.columns).alias("__probe"),
    ).select(*keys, "__line", "__t", F.lit(1).alias("__kind"), F.lit(None).cast("long").alias("__pos"), "__out", "__probe")
    both = marks.unionByName(asked).where(F.col("__t").isNotNull())
    line_keys = [*keys, "__line"]
    counted = versions.select(*keys, F.lit(0).alias("__line")).unionByName(probes.select(*keys, F.lit(0).alias("__line")))
    hot = hot_keys(counted, list(keys), hot_rows)
    if hot.frame is not None:  # every timeline of a hot key is split
        every = F.explode(F.array(*[F.lit(n) for n in lines.values()])).alias("__line")
        hot = HotKeys(hot.frame.select(*keys, every, F.lit(True).alias(_HOT)))
    scanned = chunked_scan(
        both, line_keys, time_chunk(F.col("__t"), chunk_seconds), [F.col("__t"), F.col("__kind")],
        running_max={"__rank": F.col("__pos")}, hot=hot,
    )
    rank = F.coalesce("__rank", F.lit(0).cast("long"))
    found = scanned.where("__kind = 1").select("__probe.*", "__out", rank.alias("__rank"))
    if len(times) == 1:
        (out,) = times
        return found.drop("__out").withColumnRenamed("__rank", out)
    return found.groupBy(*probes.columns).agg(
        *[F.max(F.when(F.col("__out") == out, F.col("__rank"))).alias(out) for out in times]
    )


def keep_top(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit, rank: str) -> DataFrame:
    """The first ``limit`` rows per key, numbered. ``limit`` is an int.

    The filter sits directly on the row number, so Spark cuts every key to ``limit`` rows on the
    map side (WindowGroupLimit) before it shuffles.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= F.lit(limit))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in the given order; cut on the map side."""
    return keep_top(df, keys, order, 1, "__first").drop("__first")


def nth_smallest(
    df: DataFrame, keys: Sequence[str], value: str, n: Column, out: str, *, chunk: Column, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Exact order statistic per (non-empty) key without collecting a group.

    Equal values are counted first; ``n`` (1-based, may use the column ``__total``) then picks the
    first value whose running count reaches it.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__k"))
    totals = counts.groupBy(*keys).agg(F.sum("__k").alias("__total"))
    running = chunked_scan(
        counts, keys, chunk, [F.col(value)], running_sum={"__upto": F.col("__k")}, hot_rows=hot_rows
    )
    joined = running.join(totals, list(keys))
    hit = (F.col("__upto") >= n) & (F.col("__upto") - F.col("__k") < n)
    return joined.where(hit).select(*keys, F.col(value).alias(out))
