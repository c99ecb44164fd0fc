"""Interval and as-of lookups along time, one ordered pass instead of a pair join.

Both sides are laid out on one time line per group and swept in order, so the work
grows with the number of rows, not with the number of pairs in range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwheel.operators.ordered import arrange, cut_points, last_seen, running_sum

ADD, READ, EXPIRE = 1, 2, 3
EXPIRE_FIRST = 0


def interval_totals(
    reads: DataFrame | None,
    adds: DataFrame,
    keys: Sequence[str],
    time: str,
    length: int,
    sums: dict[str, Column],
    ids: Sequence[str] = (),
    closed: bool = True,
    profile: DataFrame | None = None,
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """For each row of ``reads``, totals of ``adds`` of its group in the interval up to it.

    The interval is ``[t - length, t]``, or ``(t - length, t]`` when not ``closed``.
    ``time`` is in whole units (microseconds) on both sides and ``ids`` with ``keys``
    and ``time`` identifies a row of ``reads``; without ``ids`` the result has one row
    per instant. ``reads`` may be None to read at every instant of ``adds``.
    ``sums`` are amounts over ``adds`` without NULLs, of an exact type: amounts are
    taken away again when they expire. ``profile`` may name one scan with the key, time
    and id columns of both sides, to find large groups more cheaply.
    """
    order = (time, "_kind", *ids)
    no_ids = [F.lit(None).cast(reads.schema[c].dataType).alias(c) for c in ids]
    if profile is None:
        profile = adds.select(*keys, time, *no_ids)
        profile = profile if reads is None else profile.unionByName(reads.select(*keys, time, *ids))
    profile = profile.select(*keys, time, F.lit(READ).alias("_kind"), *ids)
    cuts = cut_points(profile, keys, order, rows_per_chunk)
    amounts = adds.select(*keys, time, *[v.alias(n) for n, v in sums.items()])
    if cuts:
        # no cut goes through an instant, so a large one is folded before the shuffle
        amounts = amounts.groupBy(*keys, time).agg(*[F.sum(n).alias(n) for n in sums])
        reads = reads if ids or reads is None else reads.select(*keys, time).distinct()
    added = F.struct(F.col(time), F.lit(ADD).alias("_kind"), *[F.col(n) for n in sums])
    expired = F.struct(
        (F.col(time) + length).alias(time),
        F.lit(EXPIRE if closed else EXPIRE_FIRST).alias("_kind"),
        *[(-F.col(n)).alias(n) for n in sums],
    )
    changes = amounts.select(*keys, F.explode(F.array(added, expired)).alias("_change")).select(
        *keys, "_change.*", *no_ids
    )
    line, asked = changes, ADD
    if reads is not None:
        nothing = [F.lit(0).alias(n) for n in sums]
        line = changes.unionByName(reads.select(*keys, time, F.lit(READ).alias("_kind"), *nothing, *ids))
        asked = READ
    frame = arrange(line, keys, order, cuts)
    totals = running_sum(frame, {f"_total_{n}": F.col(n) for n in sums}, peers=reads is None)
    found = totals.where(F.col("_kind") == asked).select(
        *keys, time, *ids, *[F.col(f"_total_{n}").alias(n) for n in sums]
    )
    # groups left whole are already together, so this distinct needs no shuffle
    return found if ids or cuts else found.distinct()


def latest_before(
    rows: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    time: str,
    ids: Sequence[str],
    take: Sequence[str],
    strict: bool = False,
    profile: DataFrame | None = None,
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """As-of lookup: the latest row of ``source`` at or before (``strict``: before) each row.

    Adds one column ``latest``, a struct of the ``take`` columns of ``source``, NULL
    where nothing came earlier. ``ids`` with ``keys`` and ``time`` identifies a row on
    both sides and breaks ties: the greatest id wins. ``profile`` may name one scan with
    the key, time and id columns of both sides, to find large groups more cheaply.
    """
    kept = [c for c in rows.columns if c not in (*keys, time, *ids)]
    latest_type = source.select(F.struct(*take).alias("s")).schema["s"].dataType
    rows_type = rows.select(F.struct(*kept).alias("s")).schema["s"].dataType if kept else None
    row_struct = F.struct(*kept) if kept else F.lit(True)
    no_row = F.lit(None).cast(rows_type or "boolean")
    # at one instant, source rows come first unless only strictly earlier ones count
    source_kind, row_kind = (READ, ADD) if strict else (ADD, READ)
    line = source.select(
        *keys, time, F.lit(source_kind).alias("_kind"), *ids,
        F.struct(*take).alias("_found"), no_row.alias("_row"),
    ).unionByName(
        rows.select(
            *keys, time, F.lit(row_kind).alias("_kind"), *ids,
            F.lit(None).cast(latest_type).alias("_found"), row_struct.alias("_row"),
        )
    )
    if profile is None:
        profile = rows.select(*keys, time, *ids).unionByName(source.select(*keys, time, *ids))
    profile = profile.select(*keys, time, F.lit(row_kind).alias("_kind"), *ids)
    order = (time, "_kind", *ids)
    frame = arrange(line, keys, order, cut_points(profile, keys, order, rows_per_chunk))
    out = last_seen(frame, F.col("_found"), "latest").where(F.col("_kind") == row_kind)
    return out.select(*keys, time, *ids, *[F.col(f"_row.{c}").alias(c) for c in kept], "latest")
