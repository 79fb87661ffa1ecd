"""Spelling variants of a corpus vocabulary, found with a variable-length gram index.

1. Words are counted over all texts, first within a task, then over all.
2. Gram dictionary: grams of ``SHORTEST`` to ``LONGEST`` code points of the padded
   words are counted. A gram is extended by a code point only where it is frequent,
   that is in more than one ``EXTENDED``-th of all places; the rest is pruned.
   Fewer than ``EXTENDED`` grams of a length can be that frequent, each with as many
   extensions as there are letters: this bounds the dictionary whatever the corpus.
3. A word is decomposed from left to right into the longest grams that the dictionary
   has, leaving out those inside an earlier one. Whether a gram is taken depends
   on a stretch of letters around it; an edit can affect only grams whose stretch it
   falls into. The largest number of grams that one edit affects is the word's bound.
4. Two words at one edit share all grams but at most that number, at places that
   differ by the length of the edit. So of each word's lists of the index only
   the rarest, one more than its bound, are merged, rarity by the dictionary's counts.
   Lists are kept by length and place of the gram, those of equal lengths apart
   from those of a length and the next one. As the padding is one less than the longest
   gram, a word always keeps a gram at one of its ends: no pair is lost.
5. Words that meet in a list are verified letter by letter, in bulk (those of more than
   ``WIDE`` letters one by one). Long lists are
   cut into blocks of ``LIST_BLOCK`` words; each two blocks meet in a group of their own.

Only verified pairs leave the tasks. Each word keeps the number of its near words and
the best of them; roots are found by doubling steps along the forms, whose
counts grow fivefold at each, so that the number of steps follows from the largest
count.

Defined results: a missing or empty text has no words; rows that repeat count each;
a missing ``doc_id`` is the empty text in the hash; further columns are not read. Texts
are read whole, whatever their length.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenara.llm.common import stored

LEAST_LETTERS, LEAST_COUNT, FOLD, DELETED = 6, 5, 5, 199
SHORTEST, LONGEST, EXTENDED = 2, 4, 20_000
HELD_WORDS = 200_000
LIST_BLOCK = 4096
PAIR_BATCH = 1 << 20
ROW_BATCH = 1 << 16
WIDE = 64
HEAD, TAIL = "\x02", "\x03"

RUN = re.compile(rf"[a-zÀ-ÿ]{{{LEAST_LETTERS},}}")


def words_of(doc_id: int | None, text: str) -> Counter:
    """Words of a text with their counts; of one run in ``DELETED`` a letter is missing."""
    found = Counter(RUN.findall(text.encode().lower().decode()))
    name = "" if doc_id is None else str(doc_id)
    out: Counter = Counter()
    for run, n in found.items():
        h = zlib.crc32(f"{name}:{run}".encode())
        if h % DELETED == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LEAST_LETTERS:
                continue
        out[run] += n
    return out


def counted(docs: DataFrame) -> DataFrame:
    """``word`` and ``n`` of all words that are long and frequent enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                held.update(words_of(doc_id, text.as_py() or ""))
                if len(held) > HELD_WORDS:
                    yield emit()
                    held.clear()
        if held:
            yield emit()

    parts = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def padded(word: str) -> str:
    return HEAD * (LONGEST - 1) + word + TAIL * (LONGEST - 1)


def gram_dictionary(words: DataFrame) -> dict[str, int]:
    """Counts of the shortest grams and of the extensions of frequent ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for word in batch.column("word").to_pylist():
                s = padded(word)
                for q in range(SHORTEST, LONGEST + 1):
                    found.update(s[i : i + q] for i in range(len(s) - q + 1))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["gram", "n"])

    parts = words.select("word").mapInArrow(run, "gram string, n long")
    grams = stored(parts.groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    short = F.length("gram") == SHORTEST
    places = grams.where(short).agg(F.sum("n")).first()[0] or 0
    frequent = grams.where(F.col("n") > F.lit(places / EXTENDED)).select(F.col("gram").alias("stem"))
    stem = F.substring("gram", F.lit(1), F.length("gram") - 1)
    kept = grams.where(~short).withColumn("stem", stem).join(frequent, "stem", "left_semi").select("gram", "n")
    return {r["gram"]: r["n"] for r in grams.where(short).union(kept).collect()}


def decomposed(s: str, dictionary: dict[str, int]) -> list[tuple[int, int]]:
    """Place and length of the grams of a padded word."""
    out, reached = [], -1
    for at in range(len(s) - SHORTEST + 1):
        size = SHORTEST
        for q in range(min(LONGEST, len(s) - at), SHORTEST, -1):
            if s[at : at + q] in dictionary:
                size = q
                break
        if at + size > reached:
            out.append((at, size))
            reached = at + size
    return out


def affected(grams: list[tuple[int, int]], letters: int) -> int:
    """The most grams that one edit of the word can change."""
    hit = [0] * (letters + 1)
    for at, size in grams:
        # the stretch of letters that decides on this gram, within the word
        first, last = max(0, at + size - 2 * LONGEST + 1), min(letters - 1, at)
        if first <= last:
            hit[first] += 1
            hit[last + 1] -= 1
    most = now = 0
    for change in hit:
        now += change
        most = max(most, now)
    return most


#: Sides of a list: words of one length; the shorter and the longer words of two lengths.
EVEN, SHORT, LONG = 0, 1, 2


def entries(words: DataFrame, dictionary: dict[str, int]) -> DataFrame:
    """The lists that must be merged: for each word its rarest grams by length and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, which, sides = [], [], []
            names = batch.column("word").to_pylist()
            for i, word in enumerate(names):
                s, letters = padded(word), len(word)
                grams = decomposed(s, dictionary)
                ranked = sorted((dictionary.get(s[a : a + q], 0), s[a : a + q], a) for a, q in grams)
                for _, gram, at in ranked[: affected(grams, letters) + 1]:
                    tagged = [(f"0 {letters} {at} {gram}", EVEN), (f"1 {letters} {at} {gram}", SHORT)]
                    if letters > LEAST_LETTERS:
                        tagged += [(f"1 {letters - 1} {p} {gram}", LONG) for p in (at, at - 1)]
                    for name, side in tagged:
                        lists.append(name)
                        which.append(i)
                        sides.append(side)
            at = pa.array(which, pa.int64())
            columns = [pa.array(lists, pa.string()), batch.column("word").take(at), batch.column("n").take(at), pa.array(sides, pa.int8())]
            yield pa.RecordBatch.from_arrays(columns, ["list", "word", "n", "side"])

    rows = words.select("word", "n").mapInArrow(run, "list string, word string, n long, side byte")
    return rows.select(F.xxhash64("list").alias("key"), "word", "n", "side")


def letters_of(column: pa.Array) -> np.ndarray:
    """Code points of words in rows of equal width, filled up with zeros."""
    names = column.to_pylist()
    x = np.array(names, dtype=f"U{1 + max(map(len, names))}")
    return x.view(np.uint32).reshape(len(names), -1).astype(np.uint16)


def one_edit(x: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows ``a`` become rows ``b``, of the same length or one longer, by one edit."""
    p, q = x[a], x[b]
    same = sizes[a] == sizes[b]
    out = np.zeros(len(a), bool)
    out[same] = (p[same] != q[same]).sum(axis=1) == 1
    rest = np.flatnonzero(~same & (sizes[b] == sizes[a] + 1))
    if len(rest):
        p, q, n = p[rest], q[rest], sizes[b[rest]]
        width = x.shape[1]
        ahead = (p != q).argmax(axis=1)  # letters in common at the start
        ahead = np.where((p == q).all(axis=1), n - 1, ahead)
        shifted = np.zeros_like(q)
        shifted[:, :-1] = q[:, 1:]
        behind = np.arange(width)[None, :] < ahead[:, None]
        out[rest] = ((p == shifted) | behind).all(axis=1)
    return out


def pairs_within(first: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every two places of each run, in batches: place ``i`` of a run with those behind it."""
    ends = np.repeat(first + counts, counts)
    place = np.arange(len(ends)) + (first[0] if len(first) else 0)
    behind = ends - place - 1
    total = np.cumsum(behind)
    start = 0
    while start < len(place):
        done = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, done + PAIR_BATCH, "right")))
        n = behind[start:stop]
        a = np.repeat(place[start:stop], n)
        b = a + 1 + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        yield a, b
        start = stop


FOUND = "a string, b string, n_a long, n_b long"
KEYS = ["key", "low", "high"]


def edited(p: str, q: str) -> bool:
    """``one_edit`` of two words of any length."""
    if len(p) > len(q):
        p, q = q, p
    if p == q or len(q) - len(p) > 1:
        return False
    low, high = 0, len(p)  # letters in common at the start, by halving
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if p[:middle] == q[:middle] else (low, middle - 1)
    return p[low + (len(p) == len(q)) :] == q[low + 1 :]


def merged(group: pa.Table) -> pa.RecordBatch:
    """Verified pairs of whole lists, sorted by ``KEYS``."""
    keys = [group.column(c).to_numpy() for c in KEYS]
    edge = np.ones(len(keys[0]), bool)
    edge[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    first = np.flatnonzero(edge)
    words, n = group.column("word").combine_chunks(), group.column("n").combine_chunks()
    mine, side = group.column("mine").to_numpy(), group.column("side").to_numpy()
    across = keys[1] != keys[2]
    sizes = pc.utf8_length(words).to_numpy()
    wide = np.maximum.reduceat(sizes, first) > WIDE
    small = pc.if_else(pa.array(sizes <= WIDE), words, "")
    x = letters_of(small)
    found = [np.zeros((2, 0), np.int64)]
    counts = np.diff(first, append=len(edge))
    for a, b in pairs_within(first, counts):
        # two blocks meet only each other, words of two lengths only those of the other
        fit = (~across[a] | (mine[a] != mine[b])) & ((side[a] == EVEN) | (side[a] != side[b]))
        a, b = a[fit], b[fit]
        flip = sizes[a] > sizes[b]
        a, b = np.where(flip, b, a), np.where(flip, a, b)
        good = one_edit(x, sizes, a, b)
        if wide.any():
            far = np.flatnonzero((sizes[a] > WIDE) | (sizes[b] > WIDE))
            good[far] = [edited(words[int(i)].as_py(), words[int(j)].as_py()) for i, j in zip(a[far], b[far], strict=True)]
        found.append(np.stack([a[good], b[good]]))
    pairs = np.concatenate(found, axis=1)
    left, right = pa.array(pairs[[0, 1]].reshape(-1)), pa.array(pairs[[1, 0]].reshape(-1))
    return pa.RecordBatch.from_arrays([words.take(left), words.take(right), n.take(left), n.take(right)], ["a", "b", "n_a", "n_b"])


def near_pairs(lists: DataFrame) -> DataFrame:
    """Verified pairs of words that share a list, both ways round; a pair may come more than once."""
    large = lists.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > LIST_BLOCK)
    sized = lists.join(large, "key", "left")
    blocks = F.coalesce(F.ceil(F.col("size") / LIST_BLOCK).cast("int"), F.lit(1))
    mine = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    dealt = sized.withColumn("blocks", blocks).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    grouped = dealt.select("key", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "mine", "word", "n", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < ROW_BATCH:
                continue
            whole = pa.Table.from_batches(held)
            last = np.ones(rows, bool)
            for c in KEYS:
                last &= whole.column(c).to_numpy() == batch.column(c)[batch.num_rows - 1].as_py()
            # the last group may go on in the next batch
            cut = int(np.flatnonzero(last)[0])
            if cut:
                yield merged(whole.slice(0, cut))
            held = whole.slice(cut).to_batches()
            rows -= cut
        if rows:
            yield merged(pa.Table.from_batches(held))

    return grouped.repartition(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(run, FOUND)


def near_words(words: DataFrame) -> DataFrame:
    """``a``, ``b``, ``n_a``, ``n_b``: every ordered pair of words at one edit, once."""
    lists = stored(entries(words, gram_dictionary(words)), "gram-lists")
    return near_pairs(lists).distinct()


def variants(docs: DataFrame) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of every word.

    The form is the near word of the largest count, if that is at least ``FOLD`` times
    the word's own; the root is where the forms lead to.
    """
    words = stored(counted(docs), "words")
    best = F.min(F.struct((-F.col("n_b")).alias("minus"), F.col("b").alias("word")))
    near = near_words(words).groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    holds = -F.col("best.minus") >= FOLD * F.col("n")
    forms = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(holds, F.col("best.word")).alias("form"), F.when(holds, -F.col("best.minus")).alias("form_n"),
    )
    forms = stored(forms, "forms")
    most = words.agg(F.max("n")).first()[0] or 1
    roots = forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(1 + math.log(most, FOLD)))):
        step = roots.select(F.col("word").alias("root"), F.col("root").alias("far"))
        roots = stored(roots.join(step, "root", "left").select("word", F.coalesce("far", "root").alias("root")), "roots")
    joined = forms.join(roots, "word", "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
