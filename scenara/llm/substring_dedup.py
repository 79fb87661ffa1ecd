"""Removal of long repeated byte strings, found in anchored suffix arrays.

A window is a string of ``window`` bytes. The smallest hash among its ``GRAM``-byte
grams (the leftmost, if equal) is its anchor, so equal windows have equal grams at
the same place. Consecutive windows of a text with one anchor form a run, and runs
of one gram value meet in a group; windows of different groups differ.

1. Runs are hashed (128 bits: gram and text). Those whose gram occurs once are left out; the others
   are counted. A run whose text occurs twice is covered as
   a whole, whatever the size of its group of copies; one of each kind goes on.
2. In each group that has two or more kinds, the contexts right of the anchors are sorted
   (a sparse suffix array) with their common prefixes; a stack scan gives the tree
   of common-prefix intervals. In an interval, members are sorted by their left
   contexts, and a second scan finds which extend left alike; where they differ
   (left-extension diversity) the repeat is maximal. Each maximal repeat of at least
   ``window`` bytes is reported with all occurrences in its interval.
3. Groups of more than ``GROUP_RUNS`` kinds are not gathered: their windows are
   hashed one by one and counted with partial sums, which is exact as well.
4. Covered bytes are united by document and removed.

A second, shorter window (``passage``) may be asked for beside the first. What it covers
is counted, not removed. Both go through the steps above together: a place that is the
anchor of runs of both sizes sends one row to step 1, and the last bit of a gram tells
the groups of the two sizes apart after it.

Defined results: a missing text is the empty text; texts shorter than a window
stay as they are; rows that repeat (equal id and text) are copies of each other;
long texts are scanned in overlapping parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from scenara.llm.common import NO_ID, Rolling, removed, slices, stored, stored_at, text_buffer

WINDOW, GRAM = 400, 32
PART_BYTES = 1 << 20
LONG_PART = 4 << 20
GROUP_RUNS = 50_000
BATCH_RUNS = 20_000

RUNS = "gram long, kind long, k1 long, k2 long, starts array<int>, windows int, anchor int"
RUN_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int32()]
BOTH_RUNS = "gram long, k1 long, k2 long, places array<int>, kind long, windows int, anchor int, short_kind long, short_windows int, short_anchor int"
BOTH_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), *[pa.int64(), pa.int32(), pa.int32()] * 2]


def names(schema: str) -> list[str]:
    return [part.strip().split(" ")[0] for part in schema.split(",")]


def anchored_runs(grams: np.ndarray, size: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, numbers of windows and anchor places of the runs of one byte array."""
    span = window - GRAM + 1
    best = (grams & ~np.uint64(2**24 - 1)) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while width * 2 <= span:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if span > width:
        best = np.minimum(best[: -(span - width)], best[span - width :])
    anchor = (best & np.uint64(2**24 - 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(anchor, prepend=-1))
    return first, np.diff(first, append=size - window + 1), anchor[first]


def parts_of(data: np.ndarray, offsets: np.ndarray, window: int) -> Iterator[tuple[int, int, int, int]]:
    """Row, start in its text, and byte range, in parts that overlap by a window less one."""
    for row in range(len(offsets) - 1):
        start, end = int(offsets[row]), int(offsets[row + 1])
        at = start
        while end - at >= window:
            yield row, at - start, at, min(end, at + LONG_PART)
            at += LONG_PART - window + 1


def find_runs(docs: DataFrame, window: int) -> DataFrame:
    """One row for each document, gram and kind of run, with its starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            k1, k2 = batch.column("k1").to_pylist(), batch.column("k2").to_pylist()
            for a, b in slices(offsets, PART_BYTES):
                found: dict[tuple, list[int]] = {}
                for row, shift, start, end in parts_of(data, offsets[a : b + 1], window):
                    part = data[start:end]
                    raw = part.tobytes()
                    grams = rolling.grams(rolling.prefix(part), GRAM)
                    first, count, anchor = anchored_runs(grams, len(part), window)
                    values = grams[anchor].view(np.int64).tolist()
                    for p, n, at, gram in zip(first.tolist(), count.tolist(), anchor.tolist(), values, strict=True):
                        kind = hashlib.blake2b(raw[p : p + n + window - 1], digest_size=8).digest()
                        found.setdefault((gram, kind, row + a, n, at - p), []).append(p + shift)
                columns = list(zip(*((g, int.from_bytes(k, "big", signed=True), k1[r], k2[r], starts, n, at) for (g, k, r, n, at), starts in found.items()), strict=True)) or [()] * len(RUN_KINDS)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, RUN_KINDS, strict=True)], names(RUNS))

    return docs.select("k1", "k2", "text").mapInArrow(run, RUNS)


def runs_of_both(data: np.ndarray, window: int, passage: int, rolling: Rolling, most: int = LONG_PART) -> Iterator[tuple]:
    """Anchor's place and gram, then kind, windows and anchor within the run, for runs of ``window`` and of ``passage`` bytes.

    A size that has no run at the place has 0 windows. A part owns the windows of either size that start in it.
    """
    step = most - window + 1
    for shift in range(0, max(0, len(data) - passage + 1), step):
        part = data[shift : shift + most]
        raw = part.tobytes()
        grams = rolling.grams(rolling.prefix(part), GRAM)
        found: dict[int, list[tuple[int, int, int]]] = {}
        for side, (least, size) in enumerate(((window, len(part)), (passage, min(len(part), step + passage - 1)))):
            if size >= least:
                for p, n, at in zip(*(x.tolist() for x in anchored_runs(grams[: size - GRAM + 1], size, least)), strict=True):
                    kind = hashlib.blake2b(raw[p : p + n + least - 1], digest_size=8).digest()
                    found.setdefault(at, [(0, 0, 0), (0, 0, 0)])[side] = (int.from_bytes(kind, "big", signed=True), n, at - p)
        values = grams.view(np.int64)
        for at, (long, short) in found.items():
            yield at + shift, int(values[at]), *long, *short


def find_both_runs(docs: DataFrame, window: int, passage: int) -> DataFrame:
    """One row for each document, gram and pair of kinds of run that share an anchor, with its places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            k1, k2 = batch.column("k1").to_pylist(), batch.column("k2").to_pylist()
            for a, b in slices(offsets, PART_BYTES):
                found: dict[tuple, list[int]] = {}
                for row in range(a, b):
                    for place, *both in runs_of_both(data[offsets[row] : offsets[row + 1]], window, passage, rolling):
                        found.setdefault((row, *both), []).append(place)
                columns = list(zip(*((gram, k1[r], k2[r], places, *both) for (r, gram, *both), places in found.items()), strict=True)) or [()] * len(BOTH_KINDS)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, BOTH_KINDS, strict=True)], names(BOTH_RUNS))

    return docs.select("k1", "k2", "text").mapInArrow(run, BOTH_RUNS)


def apart(runs: DataFrame, window: int, passage: int) -> DataFrame:
    """The runs of ``find_both_runs`` one by one, with their ``window``; the last bit of ``gram`` is the size."""

    def side(bit: int, prefix: str, size: int) -> DataFrame:
        kind, windows, anchor = (F.col(prefix + c) for c in ("kind", "windows", "anchor"))
        columns = {
            "gram": F.col("gram").bitwiseAND(F.lit(-2)).bitwiseOR(F.lit(bit)), "kind": kind, "k1": F.col("k1"), "k2": F.col("k2"),
            "starts": F.transform("places", lambda at: at - anchor), "windows": windows, "anchor": anchor, "window": F.lit(size),
        }
        return runs.where(windows > 0).select(*[c.alias(name) for name, c in columns.items()])

    return side(0, "", window).unionByName(side(1, "short_", passage))


CONTEXTS = "gram long, kind long, anchor int, windows int, window int, context binary"


def contexts_of(docs: DataFrame, chosen: DataFrame, window: int | Column) -> DataFrame:
    """The bytes of chosen runs, one for each gram and kind."""
    wanted = chosen.withColumn("window", F.lit(window)).groupBy("k1", "k2").agg(F.collect_list(F.struct("gram", "kind", "anchor", "windows", "window", "start")).alias("runs"))
    joined = docs.join(wanted, ["k1", "k2"])
    # all columns are read, so that this shuffle of the texts serves the last join too

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        for batch in batches:
            rows = []
            for text, runs in zip(batch.column("text"), batch.column("runs"), strict=True):
                raw = (text.as_py() or "").encode()
                for r in runs.as_py():
                    rows.append((r["gram"], r["kind"], r["anchor"], r["windows"], r["window"], raw[r["start"] : r["start"] + r["windows"] + r["window"] - 1]))
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names(CONTEXTS))

    return joined.select(*docs.columns, "runs").mapInArrow(run, CONTEXTS)


def prefix_intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """Common length, first and last member of the intervals of sorted strings.

    ``lcp[i]`` is the common prefix of members i and i + 1. One stack scan.
    """
    stack: list[tuple[int, int]] = []
    for i, value in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > value:
            length, first = stack.pop()
            yield length, first, i
        if value >= 0 and (not stack or stack[-1][0] < value):
            stack.append((value, first))


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def maximal_repeats(lefts: list[bytes], rights: list[bytes], least: int) -> Iterator[tuple[int, int, list[int]]]:
    """Left length, right length and members of the repeats of at least ``least`` bytes.

    ``lefts`` are the bytes before each anchor, nearest first; ``rights`` those
    from the anchor on.
    """
    order = sorted(range(len(rights)), key=rights.__getitem__)
    by_left = sorted(range(len(lefts)), key=lefts.__getitem__)
    place = {m: i for i, m in enumerate(by_left)}
    lcp = [common(rights[a], rights[b]) for a, b in zip(order, order[1:], strict=False)]
    for right, first, last in prefix_intervals(lcp):
        members = sorted(order[first : last + 1], key=place.__getitem__)
        lcs = [common(lefts[a], lefts[b]) for a, b in zip(members, members[1:], strict=False)]
        for left, i, j in prefix_intervals(lcs):
            if left + right >= least:
                yield left, right, members[i : j + 1]


def covered_starts(group: list[tuple[int, int, bytes]], window: int) -> list[list[tuple[int, int]]]:
    """For each (anchor, windows, context), the ranges of repeated window starts."""
    lefts = [context[:anchor][::-1] for anchor, _, context in group]
    rights = [context[anchor:] for anchor, _, context in group]
    out: list[list[tuple[int, int]]] = [[] for _ in group]
    for left, right, members in maximal_repeats(lefts, rights, window):
        for m in members:
            anchor, windows, _ = group[m]
            first, last = max(0, anchor - left), min(windows - 1, anchor + right - window)
            if first <= last:
                out[m].append((first, last))
    return [united(ranges) for ranges in out]


def united(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


FOUND = "gram long, kind long, ranges array<struct<first:int,last:int>>"
RANGES = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def repeats_in_groups(contexts: DataFrame) -> DataFrame:
    """Repeated window starts of each kind; groups arrive sorted by gram."""

    def emit(groups: list[tuple[int, list]]) -> pa.RecordBatch:
        rows = []
        for gram, members in groups:
            if len(members) > 1:
                for (kind, *_), ranges in zip(members, covered_starts([m[2:] for m in members], members[0][1]), strict=True):
                    if ranges:
                        rows.append((gram, kind, [{"first": a, "last": b} for a, b in ranges]))
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        kinds = [pa.int64(), pa.int64(), RANGES]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["gram", "kind", "ranges"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[tuple[int, list]] = []
        held = 0
        for batch in batches:
            for gram, *member in zip(*(batch.column(c).to_pylist() for c in ("gram", "kind", "window", "anchor", "windows", "context")), strict=True):
                if not groups or groups[-1][0] != gram:
                    if held >= BATCH_RUNS:
                        yield emit(groups)
                        groups, held = [], 0
                    groups.append((gram, []))
                if not groups[-1][1] or groups[-1][1][-1][0] != member[0]:  # repeated rows send a kind twice
                    groups[-1][1].append(tuple(member))
                    held += 1
        if groups:
            yield emit(groups)

    return contexts.repartition("gram").sortWithinPartitions("gram", "kind").mapInArrow(run, FOUND)


def repeats_by_hash(contexts: DataFrame) -> DataFrame:
    """The same for groups of any size: every window is hashed and counted."""
    schema = "gram long, kind long, at int, h1 long, h2 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gram, kind, windows, window, context in zip(*(batch.column(c).to_pylist() for c in ("gram", "kind", "windows", "window", "context")), strict=True):
                digests = b"".join(hashlib.blake2b(context[i : i + window], digest_size=16).digest() for i in range(windows))
                h = np.frombuffer(digests, np.int64).reshape(-1, 2)
                columns = [pa.array(np.full(windows, gram)), pa.array(np.full(windows, kind)), pa.array(np.arange(windows, dtype=np.int32)), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())]
                yield pa.RecordBatch.from_arrays(columns, names(schema))

    windows = stored(contexts.mapInArrow(run, schema), "windows")
    twice = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    hits = windows.join(twice, ["h1", "h2"], "left_semi")
    one = F.struct(F.col("at").alias("first"), F.col("at").alias("last"))
    return hits.groupBy("gram", "kind").agg(F.collect_list(one).alias("ranges"))


def met_runs(runs: DataFrame, places: str = "starts") -> DataFrame:
    """The runs whose gram stands at two places at least: no other can share a window.

    Grams are counted with partial sums of their own, so that the rows of a run,
    several times as wide, are sent once and only few of them again.
    """
    runs, path = stored_at(runs, "runs")
    twice = runs.groupBy("gram").agg(F.sum(F.size(places)).alias("places")).where("places > 1").drop("places")
    met = stored(runs.join(twice, "gram", "left_semi"), "met-runs")
    removed(runs.sparkSession, path)
    return met


def repeated_runs(docs: DataFrame, window: int = WINDOW, group_runs: int = GROUP_RUNS, passage: int | None = None) -> DataFrame:
    """From ``docs`` (from ``prepared``), ``k1``, ``k2``, ``runs``: the ranges of repeated window starts by document."""
    if passage is None:
        runs = met_runs(find_runs(docs, window)).withColumn("window", F.lit(window))
    else:
        runs = apart(met_runs(find_both_runs(docs, window, passage), "places"), window, passage)
    kinds = runs.groupBy("gram", "kind").agg(
        F.sum(F.size("starts")).alias("copies"),
        F.min(F.struct("k1", "k2", F.get("starts", F.lit(0)).alias("start"))).alias("one"),
        F.first("windows").alias("windows"),
        F.first("anchor").alias("anchor"),
        F.first("window").alias("window"),
    )
    kinds = stored(kinds, "kinds")
    groups = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    chosen = kinds.join(groups, "gram").select("gram", "kind", "one.*", "windows", "anchor", "window", "kinds")
    small = contexts_of(docs, chosen.where(F.col("kinds") <= group_runs), F.col("window"))
    large = contexts_of(docs, chosen.where(F.col("kinds") > group_runs), F.col("window"))
    found = repeats_in_groups(small)
    if groups.where(F.col("kinds") > group_runs).limit(1).count():
        found = found.unionByName(repeats_by_hash(large.dropDuplicates(["gram", "kind"])))
    whole = kinds.where("copies > 1").select("gram", "kind", F.array(F.struct(F.lit(0).alias("first"), (F.col("windows") - 1).alias("last"))).alias("ranges"))
    single = kinds.where("copies = 1").select("gram", "kind").join(found, ["gram", "kind"])
    results = whole.unionByName(single)
    hits = runs.join(results, ["gram", "kind"]).select("k1", "k2", "window", "starts", "ranges")
    return hits.groupBy("k1", "k2").agg(F.collect_set(F.struct("window", "starts", "ranges")).alias("runs"))


def prepared(docs: DataFrame) -> DataFrame:
    """``k1``, ``k2``, ``text`` and all other columns in the struct ``row``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(
        F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("k1"), F.xxhash64(text).alias("k2"), "text", F.struct(*others).alias("row")
    )


def cut_documents(docs: DataFrame, window: int, group_runs: int, as_text: bool, passage: int | None = None) -> DataFrame:
    """``docs`` (from ``prepared``) as ``row``, ``n_bytes``, ``n_removed``, ``n_spans``, ``n_passages``, ``n_passage_bytes``
    and ``kept``: the remaining bytes, or as text without the bytes of characters cut in two."""
    joined = docs.join(repeated_runs(docs, window, group_runs, passage), ["k1", "k2"], "left")
    sizes = [StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans", "n_passages", "n_passage_bytes")]

    def covered(hits: list[dict], size: int | None) -> list[tuple[int, int]]:
        return united([(s + r["first"], s + r["last"] + size - 1) for h in hits if h["window"] == size for s in h["starts"] for r in h["ranges"]])

    schema = StructType([docs.schema["row"], *sizes, StructField("kept", StringType() if as_text else BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, hits in zip(batch.column("text"), batch.column("runs"), strict=True):
                whole = text.as_py()
                raw = (whole or "").encode()
                found = hits.as_py() or []
                spans, passages = covered(found, window), covered(found, passage)
                ends, starts = [0, *(b + 1 for _, b in spans)], [*(a for a, _ in spans), len(raw)]
                left = [raw[a:b] for a, b in zip(ends, starts, strict=True)]
                size = sum(map(len, left))
                if as_text:
                    kept = "".join(x.decode("utf-8", "ignore") for x in left) if spans else whole
                else:
                    kept = b"".join(left)
                rows.append((len(raw), len(raw) - size, len(spans), len(passages), sum(b - a + 1 for a, b in passages), kept))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [*[pa.int64()] * 5, pa.string() if as_text else pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], schema.names)

    return joined.select(*docs.columns, "runs").mapInArrow(run, schema)


def removal_digest(docs: DataFrame, window: int = WINDOW, group_runs: int = GROUP_RUNS, passage: int | None = None) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` of every row.

    With ``passage``, at most ``window``, ``n_passages`` and ``n_passage_bytes`` follow: the runs of bytes in strings of
    that many bytes that also start elsewhere, and their length. They are counted in the input and not removed.
    """
    cut = cut_documents(prepared(docs.select("doc_id", "text")), window, group_runs, False, passage)
    more = [] if passage is None else ["n_passages", "n_passage_bytes"]
    return cut.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), *more)


def trimmed_documents(docs: DataFrame, window: int = WINDOW, group_runs: int = GROUP_RUNS) -> DataFrame:
    """``docs`` with repeated strings removed from ``text``; ``n_chars``, if there, follows.

    ``window`` is the shortest string that counts, in bytes: repeated passages of fifty
    words are found at about 200.
    """
    cut = cut_documents(prepared(docs), window, group_runs, True)
    values = {c: F.col(f"row.`{c}`") for c in docs.columns if c != "text"} | {"text": F.col("kept")}
    if "n_chars" in values:
        values["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return cut.select(*[values[c].alias(c) for c in docs.columns])
