"""Mixing sources to target weights by entropy balancing.

Among all document rates between 0 and 2 that give each source its target of
words, those closest to 1 in relative entropy have the form
``min(2, exp(lam * size / mean size))`` with one multiplier for each source: the
dual of the problem is convex, and Newton steps on it find the multipliers. A
step is a sum over the (source, size) histogram, grouped by source; multipliers
stay a table. A bracket around each multiplier keeps the steps safe.

Rates become whole copies (0, 1 or 2). Within a source, sizes are gone through
from the largest down, each takes a whole number of copies, and what rounding
leaves is carried to the next size, so that a source misses its target by about
its smallest documents. Copies go to the documents of a size by rank; ranks are
salted, so a source or size may hold any share of the rows.

Sources are numbered by ranges and their targets found from sums over the table of
sources, so that there may be as many of them as there are hosts. One task rounds the
distinct sizes of one source: a source of w words has at most sqrt(2 * w) of them.

Defined results: a missing text has size 0 and takes 0 words; a missing source
is a source of its own, sorted last; an empty table gives an empty result.
Rows that repeat are documents of their own; reruns give the same rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenara.llm.common import packed, salted_rank, stored, unpacked

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2.0
STEPS, HALVINGS, CLOSE = 40, 80, 1e-7
ROWS_A_SALT = 1_000_000
RANGES = 64


def word_count(text: Column) -> Column:
    """Runs free of space, tab, ``\\n``, ``\\v``, ``\\f`` and ``\\r``."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), "")).cast("long")


def numbered(rows: DataFrame, parts: int = RANGES) -> DataFrame:
    """``rows`` with ``place``, from 0, by code point of ``source``, null last.

    Ranges of sources are numbered apart and shifted by the counts of the ranges
    before them, so that one task orders no more than ``parts`` counts.
    """
    order = F.col("source").asc_nulls_last()
    ranged = stored(rows.repartitionByRange(parts, order).withColumn("range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("held"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("range", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("shift"))
    within = F.row_number().over(Window.partitionBy("range").orderBy(order)) - 1
    return ranged.withColumn("place", within).join(shifts, "range").withColumn("place", F.col("place") + F.col("shift")).select(*rows.columns, "place")


def source_targets(sizes: DataFrame) -> DataFrame:
    """``source``, ``source_size``, ``n``, ``target`` from rows of source, size, n.

    Every round shares what the stopped sources leave by the weights of the others, until no
    more stop: the level per weight only rises, from sums of whole numbers, one job a round.
    """
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n"))
    weight = F.get(F.array(*[F.lit(w) for w in WEIGHTS]), F.col("place") % len(WEIGHTS))
    weighed = stored(numbered(per).select("source", "source_size", "n", weight.alias("weight")), "weights")
    level, held = 0.0, -1
    while True:
        stops = F.col("weight") * F.lit(level) > CAP * F.col("source_size")
        sums = weighed.agg(
            F.sum("source_size").alias("every"), F.sum(F.when(stops, F.col("source_size"))).alias("stopped"),
            F.sum(F.when(~stops, F.col("weight"))).alias("sharing"), F.count(F.when(stops, 1)).alias("held"),
        ).first()
        if sums["held"] == held or not sums["sharing"]:
            break
        held = sums["held"]
        level = (SHARE * (sums["every"] or 0) - CAP * (sums["stopped"] or 0)) / sums["sharing"]
    target = F.least(CAP * F.col("source_size"), F.col("weight") * F.lit(level))
    return weighed.select("source", "source_size", "n", target.alias("target"))


def rate(lam: Column, x: Column) -> Column:
    return F.least(F.lit(CAP), F.exp(F.least(lam * x, F.lit(1.0))))


def at_cap(target: Column, size: Column) -> Column:
    return target >= CAP * size * (1 - 1e-12)


def multipliers(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets`` with ``lam``: Newton steps on the dual, one job each.

    Sources not done after ``STEPS`` go on by halving their bracket.
    """
    # smallest size over mean size bounds where every rate has reached the cap
    least = cells.where("size > 0").groupBy(F.col("source").alias("s")).agg(F.min("size").alias("least"))
    start = targets.join(least, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    mean = F.greatest(F.col("source_size") / F.col("n"), F.lit(1e-9))
    state = start.select(
        "source", "source_size", "n", "target", mean.alias("mean"), F.lit(0.0).alias("lam"), F.lit(-700.0).alias("low"),
        F.coalesce(math.log(CAP) * mean / F.col("least") + 1e-6, F.lit(1.0)).alias("high"),
        (at_cap(F.col("target"), F.col("source_size")) | (F.abs(F.col("source_size") - F.col("target")) <= CLOSE * F.col("target"))).alias("done"),
    )
    state = stored(state, "lam")
    entries = cells.withColumnRenamed("source", "s")
    for step in range(STEPS + HALVINGS + 1):
        if not state.where(~F.col("done")).limit(1).count():
            break
        if step == STEPS + HALVINGS:
            raise RuntimeError("source multipliers did not settle")
        x = F.col("size") / F.col("mean")
        r = rate(F.col("lam"), x)
        words = F.col("cells_n") * F.col("size")
        sums = (
            state.join(entries.withColumnRenamed("n", "cells_n"), F.col("source").eqNullSafe(F.col("s")))
            .groupBy("s")
            .agg(F.sum(words * r).alias("have"), F.sum(F.when(r < CAP, words * x * r).otherwise(0.0)).alias("slope"))
        )
        joined = state.join(sums, F.col("source").eqNullSafe(F.col("s")), "left")
        gap = F.coalesce(F.col("have"), F.lit(0.0)) - F.col("target")
        low = F.when(gap < 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(gap >= 0, F.col("lam")).otherwise(F.col("high"))
        newton = F.col("lam") - gap / F.col("slope")
        inside = F.lit(step < STEPS) & (F.col("slope") > 0) & (newton > low) & (newton < high)
        done = F.col("done") | (F.abs(gap) <= CLOSE * F.col("target")) | (high - low < 1e-12)
        lam = F.when(done, F.col("lam")).when(inside, newton).otherwise((low + high) / 2)
        state = stored(joined.select("source", "source_size", "n", "target", "mean", lam.alias("lam"), low.alias("low"), high.alias("high"), done.alias("done")), "lam")
    return state


def whole_copies(cells: pd.DataFrame) -> pd.DataFrame:
    """Copies for each size of one source; rounding is carried from large to small."""
    cells = cells.sort_values("size", ascending=False, kind="stable").reset_index(drop=True)
    size, n, want = (cells[c].to_numpy(float) for c in ("size", "n", "want"))
    copies, carry = np.zeros(len(cells), np.int64), 0.0
    for i in range(len(cells)):
        if not size[i]:
            copies[i] = int(n[i])
            continue
        words = want[i] + carry
        copies[i] = min(max(round(words / size[i]), 0), int(CAP) * int(n[i]))
        carry = words - copies[i] * size[i]
    return cells.assign(copies=copies)[["source", "size", "n", "source_size", "target", "copies"]]


def mix_plan(sizes: DataFrame) -> DataFrame:
    """Copies for each (source, size), from a table with ``source`` and ``size``."""
    cells = stored(sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    targets = stored(source_targets(cells), "targets")
    state = multipliers(cells, targets)
    rates = F.when(at_cap(F.col("target"), F.col("source_size")), F.lit(CAP)).otherwise(rate(F.col("lam"), F.col("size") / F.col("mean")))
    named = state.select(F.col("source").alias("s"), "source_size", "target", "mean", "lam")
    joined = cells.join(named, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    wanted = joined.withColumn("want", rates * F.col("size") * F.col("n")).select("source", "size", "n", "source_size", "target", "want")
    return wanted.groupBy("source").applyInPandas(
        whole_copies, "source string, size long, n long, source_size long, target double, copies long"
    )


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` with its size ``_size`` and a hash ``_k`` that orders equal sizes."""
    return docs.withColumn("_size", word_count(F.col("text"))).withColumn("_k", F.xxhash64("doc_id", "text"))


def spread(rows: DataFrame, plan: DataFrame, columns: list[str], salts: int) -> DataFrame:
    """The sized rows with ``_mix``: size, source_size, target, copies, taken."""
    ranked = salted_rank(rows, ["source", "_size"], [F.col("_k"), F.col("doc_id")], salts, "_rank")
    cells = plan.select(
        F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("n").alias("_n"), F.col("copies").alias("_c"),
        F.col("source_size").alias("_source_size"), F.col("target").alias("_target"),
    )
    joined = ranked.join(cells, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_size") == F.col("_z")), "left")
    copies = F.floor(F.col("_c") / F.col("_n")) + F.when(F.col("_rank") < F.col("_c") % F.col("_n"), 1).otherwise(0)
    fields = F.struct(
        F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        copies.alias("copies"), (copies * F.col("_size")).alias("taken"),
    )
    return joined.withColumn("_mix", fields).select(*columns, "_mix")


def mix_counts(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target``, ``taken``, ``copies`` of every row."""
    rows = stored(sized(docs.select("doc_id", "text", "source")).drop("text"), "words")
    plan = stored(mix_plan(rows.select("source", F.col("_size").alias("size"))), "plan")
    mixed = spread(rows, plan, ["doc_id"], max(8, rows.count() // ROWS_A_SALT))
    return mixed.select("doc_id", "_mix.size", "_mix.source_size", "_mix.target", "_mix.taken", "_mix.copies")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with their own columns."""
    source = F.col("source") if "source" in docs.columns else F.lit(None).cast("string")
    rows = sized(packed(docs, doc_id=F.col("doc_id"), text=F.col("text"), source=source)).drop("text")
    sizes = stored(rows.select("source", F.col("_size").alias("size")), "words")
    plan = stored(mix_plan(sizes), "plan")
    chosen = spread(rows, plan, ["row"], max(8, sizes.count() // ROWS_A_SALT)).where(F.col("_mix.copies") > 0)
    return unpacked(chosen.select("row", F.explode(F.sequence(F.lit(1), F.col("_mix.copies").cast("int")))), docs)
