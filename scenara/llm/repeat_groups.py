"""Maximal repeat groups of a corpus with all their occurrences.

The runs of ``substring_dedup`` bring all places that share an anchor into one group.
Here the enhanced suffix array of each group is read out in full: a stack scan over the
common prefixes of the right contexts gives the tree of intervals, and in each
a second one over the left contexts gives the strings with their members. A string is
reported where its members differ on the left or end there, and differ on
the right or end there: it can be extended on neither side without losing an occurrence.
A run whose text occurs more than once stands twice in its array, so that copies are
repeats like all others.

An occurrence is a place in a document; a member's places are all places of its run,
in all documents. Strings are judged within a run, the windows that share an anchor:
a passage beyond it is reported as one group for each run it crosses, which
overlap by ``window`` less one byte and together cover it. Texts of a group of more than
``group_runs`` kinds of runs are not gathered: each of its repeated windows is
a group, found by hash, so that no occurrence is lost.

Defined results: as in ``substring_dedup``; a missing text and texts shorter than a
window hold no repeat; rows that repeat (equal id and text) are copies of each other,
whose equal places are listed once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenara.llm.common import NO_ID, stored
from scenara.llm.substring_dedup import (
    GROUP_RUNS,
    WINDOW,
    common,
    contexts_of,
    find_runs,
    prefix_intervals,
    prepared,
)

Member = tuple[int, int, int, bytes]

OCCURRENCES = "gram long, group long, kind long, first int, length int"


def maximal_groups(lefts: list[bytes], rights: list[bytes], least: int) -> Iterator[tuple[int, int, list[int]]]:
    """Left length, right length and members of the repeats that no side extends.

    ``lefts`` are the bytes before each anchor, nearest first; ``rights`` those
    from the anchor on.
    """
    order = sorted(range(len(rights)), key=rights.__getitem__)
    at = {m: i for i, m in enumerate(order)}
    by_left = sorted(range(len(lefts)), key=lefts.__getitem__)
    place = {m: i for i, m in enumerate(by_left)}
    lcp = [common(rights[a], rights[b]) for a, b in zip(order, order[1:], strict=False)]
    for right, first, last in prefix_intervals(lcp):
        members = sorted(order[first : last + 1], key=place.__getitem__)
        lcs = [common(lefts[a], lefts[b]) for a, b in zip(members, members[1:], strict=False)]
        for left, i, j in prefix_intervals(lcs):
            if left + right < least:
                continue
            found = members[i : j + 1]
            # sorted by right context, the first and the last have the least in common
            low, high = min(found, key=at.__getitem__), max(found, key=at.__getitem__)
            if common(rights[low], rights[high]) == right:
                yield left, right, found


def groups_of(members: list[Member], window: int) -> Iterator[list[tuple[int, int, int]]]:
    """``kind``, first byte within its run and length, for each member of each repeat."""
    twice = [m for m in members for _ in range(min(m[1], 2))]
    lefts = [context[:anchor][::-1] for _, _, anchor, context in twice]
    rights = [context[anchor:] for _, _, anchor, context in twice]
    for left, right, found in maximal_groups(lefts, rights, window):
        yield sorted({(twice[m][0], twice[m][2] - left, left + right) for m in found})


def gathered(contexts: DataFrame, window: int) -> DataFrame:
    """``OCCURRENCES`` of groups that fit one task; they arrive sorted by gram."""

    def emit(gram: int, members: list[Member]) -> pa.RecordBatch:
        rows = [(gram, i, *place) for i, group in enumerate(groups_of(members, window)) for place in group]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["gram", "group", "kind", "first", "length"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, members = None, []
        for batch in batches:
            for g, *member in zip(*(batch.column(c).to_pylist() for c in ("gram", "kind", "copies", "anchor", "context")), strict=True):
                if g != gram:
                    if members:
                        yield emit(gram, members)
                    gram, members = g, []
                if not members or members[-1][0] != member[0]:  # repeated rows send a kind twice
                    members.append(tuple(member))
        if members:
            yield emit(gram, members)

    return contexts.repartition("gram").sortWithinPartitions("gram", "kind").mapInArrow(run, OCCURRENCES)


def window_groups(contexts: DataFrame, copies: DataFrame, window: int) -> DataFrame:
    """``OCCURRENCES`` of groups of any size: each repeated window, by its hash."""
    schema = "gram long, group string, kind long, first int, length int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gram, kind, n, context in zip(*(batch.column(c).to_pylist() for c in ("gram", "kind", "windows", "context")), strict=True):
                hashes = [hashlib.blake2b(context[i : i + window], digest_size=16).hexdigest() for i in range(n)]
                columns = [pa.array([gram] * n), pa.array(hashes), pa.array([kind] * n), pa.array(range(n), pa.int32()), pa.array([window] * n, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["gram", "group", "kind", "first", "length"])

    windows = stored(contexts.mapInArrow(run, schema), "group-windows")
    places = windows.join(copies, ["gram", "kind"]).groupBy("gram", "group").agg(F.sum("copies").alias("n"))
    return windows.join(places.where("n > 1"), ["gram", "group"], "left_semi")


def repeat_groups(docs: DataFrame, window: int = WINDOW, group_runs: int = GROUP_RUNS) -> DataFrame:
    """``group_id``, ``doc_id``, ``start``, ``length`` (bytes) of every occurrence of every repeat."""
    texts = prepared(docs.select("doc_id", "text"))
    runs = stored(find_runs(texts, window), "runs")
    kinds = runs.groupBy("gram", "kind").agg(
        F.sum(F.size("starts")).alias("copies"),
        F.min(F.struct("k1", "k2", F.get("starts", F.lit(0)).alias("start"))).alias("one"),
        F.first("windows").alias("windows"),
        F.first("anchor").alias("anchor"),
    )
    kinds = stored(kinds, "kinds")
    groups = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"), F.sum("copies").alias("places")).where("places > 1")
    chosen = kinds.join(groups, "gram").select("gram", "kind", "copies", "one.*", "windows", "anchor", "kinds")
    copies = kinds.select("gram", "kind", "copies")
    small = contexts_of(texts, chosen.where(F.col("kinds") <= group_runs), window).join(copies, ["gram", "kind"])
    found = gathered(small, window).withColumn("group", F.col("group").cast("string"))
    if groups.where(F.col("kinds") > group_runs).limit(1).count():
        large = contexts_of(texts, chosen.where(F.col("kinds") > group_runs), window).dropDuplicates(["gram", "kind"])
        found = found.unionByName(window_groups(large, copies, window))
    places = runs.select("gram", "kind", "k1", F.explode("starts").alias("at"))
    located = found.join(places, ["gram", "kind"])
    return located.select(
        F.concat_ws("-", F.hex("gram"), "group").alias("group_id"),
        F.nullif(F.col("k1"), F.lit(NO_ID)).alias("doc_id"),
        (F.col("at") + F.col("first")).cast("long").alias("start"),
        F.col("length").cast("long").alias("length"),
    ).distinct()
