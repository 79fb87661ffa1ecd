"""Benchmark decontamination as a prefix-filtered set join.

A benchmark item is cut into windows of ``size`` consecutive words (a shorter item is
one window), a window into shingles of ``SHINGLE`` words at their places. A window
occurs where a document holds at least ``share`` of its shingles at the same places
of an equally long stretch of words.

1. Documents' shingles are kept where the benchmark has them at all, and counted:
   the order of rarity, over all documents.
2. Of ``n`` shingles ``need = ceil(share * n)`` must be there, so one of the
   ``n - need + 1`` rarest is: only those are joined (one for whole windows).
   Windows with fewer than ``need`` shingles in the corpus are not joined at all.
3. The place of the joined shingle gives the one stretch it can belong to; stretches
   that begin before the first or end behind the last word drop out.
4. What is left is verified exactly: the shingles of the window, as text, at the
   places of the stretch.

All of it is DataFrame expressions; no Python runs on the executors. The benchmark
sides are joined without hints: Spark broadcasts one below its size limit and
merge joins it beyond, so nothing that grows is broadcast. Texts are never shuffled,
only the shingles that the benchmark has, and a frequent passage costs as many rows
as it has occurrences. Counts by shingle use partial sums.

Defined results: a missing text has no words; a document without words and an item
without words meet nothing; rows that repeat (equal id and text) get equal results;
items that repeat an id are one item; the windows of an item without an id mark words
but are not counted or listed; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenara.llm.common import NO_ID, stored
from scenara.llm.quality_rules import let

SIZE, SHINGLE = 10, 3
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; other letters stay as they are."""
    text = F.coalesce(text, F.lit(""))
    # a text of single bytes is ASCII, for which lower() is the same and faster
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(lowered, BREAKS), "")


def stretches(words: Column, size: int, cut: Callable[[Column, int], Column]) -> Column:
    """``cut(start, size)`` at every place where ``size`` words follow."""
    starts = F.sequence(F.lit(0), F.size(words) - size)
    return F.when(F.size(words) >= size, F.transform(starts, lambda i: cut(i, size)))


def shingles_of(words: Column, k: int) -> Column:
    """Runs of ``k`` words joined by blanks; no word holds a blank."""
    return stretches(words, k, lambda i, n: F.concat_ws(" ", *[F.get(words, i + j) for j in range(n)]))


def item_windows(items: DataFrame, size: int, share: float) -> tuple[DataFrame, DataFrame]:
    """``window`` ids with ``size``, ``need`` and ``shingles``, and the ``item_id`` of each window."""
    words = items.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    whole = F.array(F.col("words"))
    parts = stretches(F.col("words"), size, lambda i, n: F.slice(F.col("words"), i + 1, n))
    rows = words.select("item_id", F.explode(F.when(F.size("words") < size, whole).otherwise(parts)).alias("words")).distinct()
    rows = stored(rows, "item-windows")
    short = [F.when(F.size("words") == k, shingles_of(F.col("words"), k)) for k in range(1, SHINGLE)]
    shingles = F.coalesce(*short, shingles_of(F.col("words"), SHINGLE))
    distinct = rows.select("words").distinct().select(
        F.monotonically_increasing_id().alias("window"), "words", F.size("words").alias("size"), shingles.alias("shingles")
    )
    windows = stored(distinct.withColumn("need", F.ceil(F.size("shingles") * F.lit(share)).cast("int")), "windows")
    owners = windows.join(rows.where(F.col("item_id").isNotNull()), "words").select("window", "item_id")
    return windows.drop("words"), owners


def row_keys(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``k1``, ``k2`` (equal for rows of equal id and text) and ``words``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("k1"), F.xxhash64(text).alias("k2"), words_of(F.col("text")).alias("words"))


def known_shingles(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """``k1``, ``k2``, ``n_words``, ``pos``, ``shingle``: what documents share with the benchmark."""
    known = stored(windows.select(F.explode("shingles").alias("shingle")).distinct(), "known-shingles")
    lengths = [r["k"] for r in windows.select(F.least("size", F.lit(SHINGLE)).alias("k")).distinct().collect()]
    by_length = lambda w: F.array(*[F.struct(F.size(w).alias("n"), shingles_of(w, k).alias("s")) for k in sorted(lengths) or [SHINGLE]])
    split = row_keys(docs).select("k1", "k2", F.inline(let(F.col("words"), by_length)))
    rows = split.select("k1", "k2", F.col("n").alias("n_words"), F.posexplode("s").alias("pos", "shingle"))
    return stored(rows.join(known, "shingle", "left_semi"), "shared-shingles")


def rarest(windows: DataFrame, hits: DataFrame) -> DataFrame:
    """``shingle``, ``offset`` of those that must be joined, with ``window`` and ``size``."""
    counts = hits.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    at = windows.select("window", "size", "need", F.posexplode("shingles").alias("offset", "shingle"))
    at = at.join(counts, "shingle", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    order = F.sort_array(F.collect_list(F.struct("n", "shingle", "offset")))
    ordered = at.groupBy("window", "size", "need").agg(order.alias("order"), F.count_if(F.col("n") > 0).alias("present"))
    necessary = F.slice("order", F.lit(1), F.size("order") - F.col("need") + 1)
    return ordered.where(F.col("present") >= F.col("need")).select("window", "size", F.inline(necessary)).where("n > 0").drop("n")


def occurrences(docs: DataFrame, windows: DataFrame, share: float) -> DataFrame:
    """``k1``, ``k2``, ``start``, ``window``, ``size`` of every window that occurs."""
    hits = known_shingles(docs, windows)
    start = F.col("pos") - F.col("offset")
    places = hits.join(rarest(windows, hits), "shingle").withColumn("start", start)
    places = places.where((F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("n_words")))
    places = stored(places.select("k1", "k2", "start", "window", "size").distinct(), "places")
    wanted = windows.select("window", "need", F.posexplode("shingles").alias("at", "shingle"))
    parts = places.join(wanted, "window").withColumn("pos", F.col("start") + F.col("at"))
    there = parts.join(hits, ["k1", "k2", "pos", "shingle"], "left_semi")
    found = there.groupBy("k1", "k2", "start", "window", "size").agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need"))
    return stored(found.where("n >= need").select("k1", "k2", "start", "window", "size"), "occurrences")


def covered(spans: Column) -> Column:
    """Words in any of the spans, which are sorted by ``start``."""

    def step(state: Column, span: Column) -> Column:
        end = span["start"] + span["size"]
        fresh = F.greatest(F.lit(0), end - F.greatest(span["start"], state["end"]))
        return F.struct((state["n"] + fresh).alias("n"), F.greatest(state["end"], end).alias("end"))

    return F.aggregate(spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda s: s["n"].cast("long"))


def contamination(docs: DataFrame, items: DataFrame, size: int = SIZE, share: float = 1.0) -> DataFrame:
    """One row for each document: ``doc_id``, ``n_words``, ``n_hit``, ``n_items``, ``item_ids``
    (of the items with occurring windows, sorted as strings) and ``contaminated``.

    ``share`` is the part of a window's shingles that must be in place; 1 finds the
    windows that stand in the document word for word.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be above 0 and at most 1")
    windows, owners = item_windows(items, size, share)
    found = occurrences(docs, windows, share)
    by_doc = found.groupBy("k1", "k2").agg(covered(F.sort_array(F.collect_set(F.struct("start", "size")))).alias("n_hit"))
    owned = found.select("k1", "k2", "window").distinct().join(owners, "window").select("k1", "k2", F.col("item_id").cast("string").alias("item")).distinct()
    by_item = owned.groupBy("k1", "k2").agg(F.sort_array(F.collect_list("item")).alias("item_ids"))
    rows = row_keys(docs).select("doc_id", "k1", "k2", F.size("words").cast("long").alias("n_words"))
    joined = rows.join(by_doc.join(by_item, ["k1", "k2"], "left"), ["k1", "k2"], "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), (n_hit > 0).alias("contaminated"))


def digest(rows: DataFrame) -> DataFrame:
    """``contamination`` with the hash of the comma-joined item ids in their place."""
    return rows.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"), "contaminated"
    )
