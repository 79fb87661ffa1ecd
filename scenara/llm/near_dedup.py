"""Near-duplicate classes by Order MinHash and MinHash, verified by banded alignment.

Texts are sequences of words (runs free of ASCII white space, A-Z lower-cased).
The k-mers are five-word shingles labelled by their occurrence. Each of
``SKETCHES`` sketches takes the ``PICKED`` smallest labelled k-mers and keeps
their order in the text, so that a sketch is shared by texts with much content
in the same order. As many plain sketches of the set of shingles, and of the
labelled ones, each hash the minima of ``PICKED`` random orders, wherever they
stand. Whatever the order and the repeats, texts whose sets or labelled shingles
are alike at 0.8 share none of these with probability 0.36 ** 16, about 8e-8.

Texts with the same words are one node from the start. In every bucket of a
sketch, members are first compared with the bucket's most central text (the one
in the fullest buckets), one pair for a member. After that most buckets lie in
one component. Buckets that do not are gone through in blocks of bounded size, twice. First
without texts: a member stays if another of a different component, in the first bucket
they share, passes by size and by an upper bound of the overlap from stored bitmaps. Then
the texts of those that stay are compared in the task, by the same bounds and exactly.
Only links are given out. No bucket is capped, and no list of all pairs is made.

A pair is linked if the aligned shingles are at least 0.8 of all its shingles,
or, where content has moved, the sets of shingles have a Jaccard similarity of
0.8 or more. The alignment runs within the band that 0.8 allows, in memory that grows
with the text, and only where the sets do not link the pair. Classes are the
connected components, found by repeated joins of tables in the shared folder.

Defined results: rows without a word (missing, empty or blank text) are classes
of their own; texts under five words match equal texts only; repeated rows and
equal texts share a class. ``class_id`` is the smallest ``doc_id`` of a class
(rows without an id count as the smallest).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenara.llm.common import NO_ID, Rolling, keyed, mix, packed, slices, stored, text_buffer, unpacked, word_spans

SHINGLE, SIMILAR = 5, 0.8
SKETCHES, PICKED = 16, 2
SLICE = 1 << 20
BLOCK_ROWS, BLOCK_BYTES = 1024, 8 << 20
MOST_BITS = 1 << 17
ROUNDS = 60

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_RANDOM = np.random.default_rng(20)
SEEDS = _RANDOM.integers(1, 2**63, SKETCHES, dtype=np.uint64)
ODD = _RANDOM.integers(1, 2**63, SKETCHES, dtype=np.uint64) | np.uint64(1)
PLAIN_SEEDS = _RANDOM.integers(1, 2**63, (SKETCHES, PICKED), dtype=np.uint64)
PLAIN_ODD = _RANDOM.integers(1, 2**63, (SKETCHES, PICKED), dtype=np.uint64) | np.uint64(1)
MOST = np.uint64(2**64 - 1)


def word_hashes(data: np.ndarray, offsets: np.ndarray, rolling: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some rows, and the n + 1 offsets of the rows in them."""
    part = LOWER[data[offsets[0] : offsets[-1]]]
    starts, ends = word_spans(part)
    # a word never runs over the end of its row
    cut = np.setdiff1d(offsets[1:-1] - offsets[0], starts)
    cut = cut[(np.searchsorted(starts, cut) > 0)]
    inside = cut[ends[np.searchsorted(starts, cut) - 1] > cut] if len(cut) else cut
    starts, ends = np.sort(np.concatenate([starts, inside])), np.sort(np.concatenate([ends, inside]))
    prefix = rolling.prefix(part)
    return rolling.spans(prefix, starts, ends), np.searchsorted(starts, offsets - offsets[0])


def shingle_hashes(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of some rows, and the offsets of the rows in them."""
    sizes = np.diff(offsets)
    counts = np.maximum(0, sizes - SHINGLE + 1)
    n = max(0, len(words) - SHINGLE + 1)
    every = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        every = mix(every + words[i : i + n])
    out = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(out[-1]) + np.repeat(offsets[:-1] - out[:-1], counts)
    return every[at], out


def occurrences(shingles: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often each shingle stands before within its row."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((shingles, row))
    s, r = shingles[order], row[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    nth = np.empty(len(s), np.uint64)
    nth[order] = (np.arange(len(s)) - first).astype(np.uint64)
    return nth


def labelled(shingles: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """Shingles told apart by their occurrence within the row."""
    return mix(shingles + nth * np.uint64(0x9E3779B97F4A7C15))


def scrambled(labels: np.ndarray, seed: np.uint64, odd: np.uint64) -> np.ndarray:
    """Places of the labels in a random order."""
    v = (labels ^ seed) * odd
    v ^= v >> np.uint64(32)
    v *= np.uint64(0xD6E8FEB86659FD93)
    return v


def order_sketches(labels: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows by sketches: hashes of the smallest labels in text order; rows must not be empty."""
    begins, counts = offsets[:-1], np.diff(offsets)
    out = np.zeros((len(begins), SKETCHES), np.uint64)
    place = np.arange(len(labels))
    for j in range(SKETCHES):
        v = scrambled(labels, SEEDS[j], ODD[j])
        picked = []
        for _ in range(PICKED):
            least = np.minimum.reduceat(v, begins)
            here = np.minimum.reduceat(np.where(v == np.repeat(least, counts), place, len(labels)), begins)
            picked.append(here)
            if len(picked) < PICKED:
                v[here] = MOST
        first, *rest = np.sort(np.stack(picked), axis=0)
        value = mix(labels[first] + np.uint64(j + 1))
        for at in rest:
            value = mix(value + labels[at])
        out[:, j] = value
    return out


def plain_sketches(labels: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows by sketches: hashes of the minima of some random orders; rows must not be empty."""
    out = np.zeros((len(offsets) - 1, SKETCHES), np.uint64)
    for j in range(SKETCHES):
        value = np.uint64(SKETCHES + j + 1)
        for seed, odd in zip(PLAIN_SEEDS[j], PLAIN_ODD[j], strict=True):
            value = mix(value + np.minimum.reduceat(scrambled(labels, seed, odd), offsets[:-1]))
        out[:, j] = value
    return out


def all_sketches(labels: np.ndarray, first: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Order sketches, plain sketches of the sets and of the labelled shingles.

    The set is the shingles labelled as first occurrences, so that the last two are
    equal for a row without repeats.
    """
    of_bags = plain_sketches(labels, offsets)
    of_sets = of_bags if first.all() else plain_sketches(labels[first], np.append(0, np.cumsum(first))[offsets])
    return np.hstack([order_sketches(labels, offsets), of_sets, of_bags])


def sketch_rows(rows: DataFrame) -> DataFrame:
    """``doc_id``, ``k1``, ``k2``, identity of the words ``w1``, ``w2`` (null without words),
    number of words, sketches, and of the set of shingles and of the labelled ones (null
    if none repeats) the size and the bitmap."""
    schema = "doc_id long, k1 long, k2 long, w1 long, w2 long, words int, sketches array<long>, kinds int, set_bits binary, bag_bits binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for a, b in slices(offsets, SLICE):
                part = offsets[a : b + 1]
                hashes, at = word_hashes(data, part, rolling)
                ids = [hashlib.blake2b(hashes[x:y].tobytes(), digest_size=16).digest() if y > x else None for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                shingles, s_at = shingle_hashes(hashes, at)
                full = np.flatnonzero(np.diff(s_at))
                sketches: list[list[int] | None] = [None] * (b - a)
                kinds, set_bits, bag_bits = ([None] * (b - a) for _ in range(3))
                if len(full):
                    offsets_of = np.append(s_at[full], s_at[-1])
                    nth = occurrences(shingles, offsets_of)
                    labels = labelled(shingles, nth)
                    got = all_sketches(labels, nth == 0, offsets_of).view(np.int64)
                    for at_full, (i, values) in enumerate(zip(full.tolist(), got.tolist(), strict=True)):
                        x, y = offsets_of[at_full : at_full + 2]
                        bag, once = labels[x:y], nth[x:y] == 0
                        kinds[i] = int(once.sum())
                        sketches[i] = values
                        set_bits[i] = bitmap(bag[once], width(kinds[i])).tobytes()
                        bag_bits[i] = None if kinds[i] == y - x else bitmap(bag, width(int(y - x))).tobytes()
                half = lambda i: pa.array([None if x is None else int.from_bytes(x[i : i + 8], "big", signed=True) for x in ids], pa.int64())  # noqa: B023, E731
                columns = [*(batch.column(c).slice(a, b - a) for c in ("doc_id", "k1", "k2")), half(0), half(8), pa.array(np.diff(at), pa.int32()), pa.array(sketches, pa.list_(pa.int64())), pa.array(kinds, pa.int32()), pa.array(set_bits, pa.binary()), pa.array(bag_bits, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return rows.select("doc_id", "k1", "k2", "text").mapInArrow(run, schema)


def matched_runs(a: list[int], b: list[int], band: int) -> tuple[int, int] | None:
    """Words matched by an alignment with the fewest insertions and deletions: those that
    only open a run, and those that end a shingle within their run; None if it takes more
    than ``band`` edits.

    Each diagonal carries its sums along, so that memory grows with the band only.
    """
    n, m = len(a), len(b)
    if abs(n - m) > band:
        return None
    start = 0
    while start < min(n, m) and a[start] == b[start]:
        start += 1
    stop = 0
    while stop < min(n, m) - start and a[n - 1 - stop] == b[m - 1 - stop]:
        stop += 1
    a, b = a[start : n - stop], b[start : m - stop]
    n, m = len(a), len(b)
    if not n or not m:
        # nothing is left between the ends but words of one side
        runs = [start + stop] if not n and not m else [start, stop]
        ends = sum(max(0, r - SHINGLE + 1) for r in runs)
        return sum(runs) - ends, ends
    # by diagonal: place reached, length of the last run, shingles of the runs before it
    reach, last, closed = {1: 0}, {1: 0}, {1: 0}
    for edits in range(min(band, n + m) + 1):
        for k in range(-edits, edits + 1, 2):
            down = k == -edits or (k != edits and reach.get(k - 1, -1) < reach.get(k + 1, -1))
            come = k + 1 if down else k - 1
            x = first = reach[come] if down else reach[come] + 1
            y = x - k
            while x < n and y < m and a[x] == b[y]:
                x, y = x + 1, y + 1
            # the first run goes on from the equal starts of both sides
            closed[k] = closed[come] + max(0, last[come] - SHINGLE + 1) if edits else 0
            reach[k], last[k] = x, x - first + (0 if edits else start)
            if x >= n and y >= m:
                ends = closed[k] + max(0, last[k] + stop - SHINGLE + 1)
                return start + stop + (n + m - edits) // 2 - ends, ends
    return None


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of arrays without repeats."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def width(n: int) -> int:
    """Bits of the bitmap of ``n`` values: a power of two."""
    return min(MOST_BITS, 1 << max(6, (2 * n - 1).bit_length()))


def bitmap(bag: np.ndarray, bits: int) -> np.ndarray:
    """The bits that the values fall on, in bytes. Its halves joined by or are the bitmap of half the width."""
    hit = np.zeros(bits, bool)
    hit[(bag & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(hit)


def bitmaps(bags: list[np.ndarray]) -> np.ndarray:
    """A row of bits for each array, all of one width."""
    bits = width(max(map(len, bags)))
    return np.stack([bitmap(bag, bits) for bag in bags]).view(np.uint64)


def may_overlap(mine: np.ndarray, n: int, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether ``overlap`` can reach ``SIMILAR``: a bit of one side only is a value of that side only."""
    most = np.minimum(n - np.bitwise_count(mine & ~others).sum(axis=1, dtype=np.int64), sizes - np.bitwise_count(others & ~mine).sum(axis=1, dtype=np.int64))
    return most / np.maximum(1, n + sizes - most) >= SIMILAR


def alike(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> bool:
    """Whether two texts (words, shingles, labels) are linked; aligned only if the sets do not link them."""
    if overlap(np.unique(a[1]), np.unique(b[1])) >= SIMILAR:
        return True
    if overlap(a[2], b[2]) < SIMILAR:
        return False
    total = len(a[1]) + len(b[1])
    band = int(total * (1 - 2 * SIMILAR / (1 + SIMILAR))) + 1
    runs = matched_runs(a[0].tolist(), b[0].tolist(), band)
    same = runs[1] if runs else 0
    return same / max(1, total - same) >= SIMILAR


def texts_of(column: pa.Array, rolling: Rolling) -> Iterator[tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]]:
    """Word hashes, shingles and labelled shingles of the rows, in runs of rows."""
    data, offsets = text_buffer(column)
    for a, b in slices(offsets, SLICE):
        words, at = word_hashes(data, offsets[a : b + 1], rolling)
        shingles, s_at = shingle_hashes(words, at)
        labels = labelled(shingles, occurrences(shingles, s_at))
        cut = lambda x, y: [x[i:j] for i, j in zip(y[:-1].tolist(), y[1:].tolist(), strict=True)]
        yield cut(words, at), cut(shingles, s_at), cut(labels, s_at)


def verified(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """The pairs ``a``, ``b`` that are linked."""
    left = bodies.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = bodies.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            sides = [[x for part in texts_of(batch.column(name), rolling) for x in zip(*part, strict=True)] for name in ("text_a", "text_b")]
            keep = pa.array([alike(x, y) for x, y in zip(*sides, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(keep)

    return joined.mapInArrow(run, "a long, b long")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``id``, ``component`` (its smallest id) for every node, by label passing and jumping."""
    edges = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = stored(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    for _ in range(ROUNDS):
        near = edges.join(labels, edges["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("near"))
        passed = labels.join(near, labels["id"] == near["a"]).select("id", "component", F.least("component", "near").alias("next"))
        jump = labels.select(F.col("id").alias("j"), F.col("component").alias("far"))
        moved = passed.join(jump, F.col("next") == F.col("j"), "left").select("id", "component", F.least("next", "far").alias("next"))
        step = stored(moved, "labels")
        labels = step.select("id", F.col("next").alias("component"))
        if not step.where(F.col("next") != F.col("component")).limit(1).count():
            break
    else:
        raise RuntimeError("components did not settle")
    return nodes.select("id").join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


BLOCK_PAIR = ["bucket", "low", "high"]


def in_block_pairs(members: DataFrame, columns: list[str]) -> DataFrame:
    """The members, once for every two blocks of their bucket that theirs is one of, sorted by them.

    ``members`` has ``bucket``, ``id``, ``load`` (bytes) and ``columns``. Buckets are cut into blocks
    of about ``BLOCK_ROWS`` rows or ``BLOCK_BYTES``, whichever gives more.
    """
    whole = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.sum("load").alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK_ROWS), F.ceil(F.col("bytes") / BLOCK_BYTES), F.lit(1)).cast("int")
    mine = F.pmod(F.hash("id"), F.col("blocks"))
    dealt = members.join(whole, "bucket").withColumn("blocks", blocks).withColumn("mine", mine)
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    named = met.select("bucket", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "mine", "id", *columns)
    return named.repartition(*BLOCK_PAIR).sortWithinPartitions(*BLOCK_PAIR)


def candidates_of(sizes: np.ndarray, comps: np.ndarray, blocks: np.ndarray, found: np.ndarray, bucket: int) -> Iterator[tuple[int, np.ndarray]]:
    """For members in order of size: those before of a size that allows a link, of another component
    and block (if there are two), that share this bucket first."""
    across = len(set(blocks.tolist())) > 1
    for i in range(1, len(sizes)):
        first = int(np.searchsorted(sizes, int(np.ceil(SIMILAR * sizes[i] - 1e-9))))
        apart = comps[first:i] != comps[i]
        if across:
            apart &= blocks[first:i] != blocks[i]
        near = np.flatnonzero(apart) + first
        if len(near):
            same = found[near] == found[i]
            # a pair is compared in the first bucket it shares
            near = near[(found[i][same.argmax(axis=1)] == bucket) & same.any(axis=1)]
        if len(near):
            yield i, near


def with_partner(group: list[tuple], bucket: int) -> set[int]:
    """Ids of the members whose bitmaps allow a link with another one."""
    *numbers, sketches, set_bits, bag_bits = zip(*group, strict=True)
    blocks, ids, comps, kinds, counts = (np.array(x, np.int64) for x in numbers)
    found, set_bits, bag_bits = np.stack(sketches), np.array(set_bits, object), np.array(bag_bits, object)
    repeats = np.array([x is not None for x in bag_bits])
    out: set[int] = set()
    for sizes, bits in ((kinds, set_bits), (counts, np.where(repeats, bag_bits, set_bits))):
        order = np.argsort(sizes, kind="stable")
        sizes, bits = sizes[order], bits[order]
        wide = np.array([len(x) for x in bits])
        # in order of size, bitmaps of one width are neighbours
        starts = {int(w): int(np.searchsorted(wide, w)) for w in np.unique(wide)}
        rows = {w: np.stack([np.frombuffer(x, np.uint64) for x in bits[wide == w]]) for w in starts}
        for i, near in candidates_of(sizes, comps[order], blocks[order], found[order], bucket):
            w = int(wide[i])
            cut, mine = starts[w], rows[w][i - starts[w]]
            # sizes that allow a link lie in two widths at most
            sides = [(near[near >= cut], mine, w)]
            if near[0] < cut:
                sides.append((near[near < cut], np.bitwise_or(*mine.reshape(2, -1)), w // 2))
            for close, own, at in sides:
                if len(close):
                    close = close[may_overlap(own, int(sizes[i]), rows[at][close - starts[at]], sizes[close])]
                if len(close):
                    out.add(int(ids[order[i]]))
                    out.update(ids[order[close]].tolist())
        # without repeats the labelled shingles are the sets
        if not repeats.any():
            break
    return out


def members_to_compare(rest: DataFrame) -> DataFrame:
    """``bucket`` and ``id`` of the members that may be linked with one of another component.

    ``rest`` has ``bucket``, ``id``, ``component``, ``sketches``, ``kinds``, ``words`` and the bitmaps;
    no text is needed, and at most one row a member and pair of blocks is given out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []

        def emit() -> pa.RecordBatch:
            ids = sorted(with_partner(group, key[0])) if len({g[2] for g in group}) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(ids), pa.int64()), pa.array(ids, pa.int64())], ["bucket", "id"])

        for batch in batches:
            names = (*BLOCK_PAIR, "mine", "id", "component", "sketches", "kinds", "words", "set_bits", "bag_bits")
            for bucket, low, high, mine, id_, component, sketches, kinds, words, *bits in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if (bucket, low, high) != key:
                    if group:
                        yield emit()
                    key, group = (bucket, low, high), []
                group.append((mine, id_, component, kinds, words - SHINGLE + 1, np.array(sketches), *bits))
        if group:
            yield emit()

    load = F.octet_length("set_bits") + F.coalesce(F.octet_length("bag_bits"), F.lit(0)) + 8 * F.size("sketches")
    pairs = in_block_pairs(rest.withColumn("load", load.cast("long")), ["component", "sketches", "kinds", "words", "set_bits", "bag_bits"])
    return pairs.mapInArrow(run, "bucket long, id long").distinct()


def links_across(rest: DataFrame) -> DataFrame:
    """Links between texts of different components that share a bucket.

    ``rest`` has ``bucket``, ``id``, ``component``, ``sketches`` and ``text``.
    """

    def compare(group: list[tuple], bucket: int) -> list[tuple[int, int]]:
        blocks, ids, comps, sketches, sets, labels = zip(*group, strict=True)
        root: dict[int, int] = {c: c for c in comps}

        def top(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        out: list[tuple[int, int]] = []
        # sets of shingles first, as those links always hold; then labelled ones
        for bags, certain in ((sets, True), (labels, False)):
            sizes = np.array([len(x) for x in bags])
            order = np.argsort(sizes, kind="stable")
            sizes, found, bits = sizes[order], np.stack(sketches)[order], bitmaps(bags)[order]
            comp, part = np.array(comps)[order], np.array(blocks)[order]
            for i, near in candidates_of(sizes, comp, part, found, bucket):
                near = near[may_overlap(bits[i], int(sizes[i]), bits[near], sizes[near])]
                me = order[i]
                for j in near.tolist():
                    you = order[j]
                    if top(comps[me]) == top(comps[you]):
                        continue
                    if overlap(bags[me], bags[you]) >= SIMILAR:
                        if certain:
                            root[top(comps[me])] = top(comps[you])
                        out.append((ids[me], ids[you]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, key, group = Rolling(), None, []

        def emit() -> pa.RecordBatch:
            pairs = compare(group, key[0]) if len({g[2] for g in group}) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            bags = [x for _, shingles, labels in texts_of(batch.column("text"), rolling) for x in zip(shingles, labels, strict=True)]
            columns = [batch.column(c).to_pylist() for c in (*BLOCK_PAIR, "mine", "id", "component", "sketches")]
            for i, (bucket, low, high, mine, id_, component, sketches) in enumerate(zip(*columns, strict=True)):
                if (bucket, low, high) != key:
                    if group:
                        yield emit()
                    key, group = (bucket, low, high), []
                group.append((mine, id_, component, np.array(sketches), np.unique(bags[i][0]), np.sort(bags[i][1])))
        if group:
            yield emit()

    pairs = in_block_pairs(rest.withColumn("load", F.octet_length("text").cast("long")), ["component", "sketches", "text"])
    return pairs.mapInArrow(run, "a long, b long")


def near_classes(rows: DataFrame) -> DataFrame:
    """``rows`` (from ``keyed``) as ``doc_id``, ``k1``, ``k2``, ``class_k1``, ``class_k2``: the
    smallest row key of the class."""
    sketched = stored(sketch_rows(rows), "sketches")
    worded = sketched.where(F.col("w1").isNotNull())
    made = ["sketches", "kinds", "words", "set_bits", "bag_bits"]
    nodes = worded.groupBy("w1", "w2").agg(F.min(F.struct("k1", "k2")).alias("one"), F.first(F.struct(*made)).alias("made"))
    nodes = stored(nodes.select(F.monotonically_increasing_id().alias("id"), "w1", "w2", "one.*", "made.*"), "nodes")
    entries = nodes.where(F.col("sketches").isNotNull()).select("id", F.explode(F.array_distinct("sketches")).alias("bucket"))
    full = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    entries = stored(entries.join(full, "bucket"), "buckets")
    involved = entries.groupBy("id").agg(F.sum("size").alias("weight"))
    bodies = nodes.join(involved, "id").select("id", "k1", "k2", "weight")
    bodies = stored(bodies.join(rows.select("k1", "k2", "text"), ["k1", "k2"]).dropDuplicates(["id"]).select("id", "weight", "text"), "bodies")
    weights = bodies.select("id", "weight")
    central = entries.join(weights, "id").groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("id")).alias("minus"))).alias("c"))
    stars = entries.join(central, "bucket").select(F.col("id").alias("a"), (-F.col("c.minus")).alias("b")).where("a != b")
    # a pair that several buckets give is compared once
    pairs = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = stored(verified(pairs, bodies), "links")
    first = stored(components(nodes, links), "components")
    placed = entries.join(first, "id").select("bucket", "id", "component")
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most")
    rest = placed.join(mixed.select("bucket"), "bucket").join(nodes.select("id", *made), "id")
    hopeful = stored(members_to_compare(rest), "members")
    rest = hopeful.join(first, "id").join(bodies.select("id", "text"), "id").join(nodes.select("id", "sketches"), "id")
    more = verified(links_across(rest).distinct(), bodies)
    links = stored(links.select("a", "b").union(more.select("a", "b")), "links")
    final = components(nodes, links)
    named = stored(nodes.select("id", "w1", "w2", "k1", "k2").join(final, "id"), "classes")
    least = named.groupBy("component").agg(F.min(F.struct("k1", "k2")).alias("least"))
    classes = named.join(least, "component").select("w1", "w2", F.col("least.k1").alias("c1"), F.col("least.k2").alias("c2"))
    joined = sketched.select("doc_id", "k1", "k2", "w1", "w2").join(classes, ["w1", "w2"], "left")
    return joined.select("doc_id", "k1", "k2", F.coalesce("c1", "k1").alias("class_k1"), F.coalesce("c2", "k2").alias("class_k2"))


def class_of_documents(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``class_id`` and ``first``: the row is the one its class keeps."""
    placed = near_classes(keyed(docs))
    own = (F.col("k1") == F.col("class_k1")) & (F.col("k2") == F.col("class_k2"))
    return placed.select("doc_id", F.col("class_k1").alias("class_id"), own.alias("first"))


def distinct_documents(docs: DataFrame) -> DataFrame:
    """One document of each class, with its own columns."""
    placed = near_classes(keyed(docs))
    chosen = placed.select(F.col("class_k1").alias("k1"), F.col("class_k2").alias("k2")).distinct()
    keys = packed(docs, k1=F.coalesce(F.col("doc_id"), F.lit(NO_ID)), k2=F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    return unpacked(keys.join(chosen, ["k1", "k2"]).dropDuplicates(["k1", "k2"]), docs)
