"""Operators over the whole corpus against brute force."""

import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import brute
from scenara.llm import near_dedup, packing, source_mix, substring_dedup, token_counts, tokens, top_k
from scenara.llm.catalog import QUERIES


@pytest.fixture(scope="module")
def tokenizer():
    return tokens.library()


@given(st.text(max_size=60) | st.text("a b'st\n\t\x1c\x85  <|endoftext|>1é", max_size=60))
@settings(max_examples=300, deadline=None)
def test_rank_encoder_and_pre_tokens(text):
    library, ranks = test_rank_encoder_and_pre_tokens.made
    expected = library.encode(text, add_special_tokens=False).ids
    assert ranks.ids(text).tolist() == expected
    pieces = [library.encode(t, add_special_tokens=False).ids for t in tokens.pre_tokens(text)]
    assert sum(pieces, []) == expected


test_rank_encoder_and_pre_tokens.made = (tokens.library(), tokens.RankEncoder())


@pytest.mark.parametrize("source", ["odd_docs", "documents"])
def test_token_counts(request, tokenizer, source):
    docs = request.getfixturevalue(source)
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(docs).collect()), key=repr)
    texts = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    assert got == sorted(((i, len(t.encode()), len(tokenizer.encode(t, add_special_tokens=False).ids)) for i, t in texts), key=repr)


def test_token_counts_in_many_blocks(documents, tokenizer, monkeypatch):
    block = token_counts.Block()
    texts = [r["text"] for r in documents.limit(40).collect()]
    for i, t in enumerate(texts):
        block.add(i, t)
    row = {c: v[0] for c, v in block.batch(0).to_pydict().items()}
    pieces = np.array([len(tokenizer.encode(t, add_special_tokens=False).ids) for t in row["tokens"]])
    assert token_counts.sums(row, pieces).tolist() == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    assert token_counts.count_tokens(documents.where("false")).count() == 0


@pytest.mark.parametrize("source", ["odd_docs", "documents"])
def test_packing(request, tokenizer, source):
    docs = request.getfixturevalue(source)
    rows = packing.pack(docs).collect()
    expected = Counter()
    for r in docs.collect():
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        start, end, piece = 0, (len(ids) - 1) % 1024 + 1, 0
        while start < len(ids):
            expected[(r["doc_id"], piece, start, end - start, zlib.crc32(ids[start:end].tobytes()))] += 1
            start, end, piece = end, end + 1024, piece + 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= brute.best_fit_decreasing([r["length"] for r in rows], 1024)


@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), min_size=1, max_size=12))
@settings(max_examples=100, deadline=None)
def test_minimum_bin_slack(histogram):
    plan = packing.pack_lengths(histogram, 60, (0,))
    used = Counter()
    left = Counter(histogram)
    for bin_, times in plan:
        size = sum(k * n for k, n in bin_.items())
        assert size <= 60 and max(bin_) == max(k for k, n in left.items() if n)
        reach = {max(left)}
        for k, n in left.items():
            for _ in range(n - (k == max(left))):
                reach |= {x + k for x in reach if x + k <= 60}
        assert size == max(reach)
        for k, n in bin_.items():
            used[k] += n * times
            left[k] -= n * times
        left = +left
    assert used == Counter(histogram)
    places = packing.Places(plan)
    seen = defaultdict(list)
    for length, n in histogram.items():
        seq, off = places.find(np.full(n, length), np.arange(n))
        for s, o in zip(seq.tolist(), off.tolist(), strict=True):
            seen[s].append((o, length))
    for parts in seen.values():
        assert sorted(o for o, _ in parts) == [sum(x for _, x in sorted(parts)[:i]) for i in range(len(parts))]


@pytest.mark.parametrize(("source", "group_runs"), [("odd_docs", 50_000), ("documents", 50_000), ("documents", 2)])
def test_substring_dedup(request, source, group_runs):
    docs = request.getfixturevalue(source)
    rows = docs.collect()
    expected = sorted(((r["doc_id"], *x) for r, x in zip(rows, brute.removed([r["text"] for r in rows], 400), strict=True)), key=repr)
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    got = substring_dedup.removal_digest(docs, group_runs=group_runs).select(*cols).collect()
    assert sorted((tuple(r) for r in got), key=repr) == expected


@given(st.lists(st.text("ab", max_size=80), max_size=6), st.integers(33, 40))
@settings(max_examples=60, deadline=None)
def test_covered_starts(texts, window):
    """Groups of runs cover exactly the repeated windows."""
    rolling = substring_dedup.Rolling()
    groups = defaultdict(list)
    for t, text in enumerate(texts):
        data = np.frombuffer(text.encode(), np.uint8)
        if len(data) < window:
            continue
        grams = rolling.grams(rolling.prefix(data), substring_dedup.GRAM)
        for p, n, at in zip(*(x.tolist() for x in substring_dedup.anchored_runs(grams, len(data), window)), strict=True):
            groups[grams[at]].append((t, p, at - p, n, text.encode()[p : p + n + window - 1]))
    got = set()
    for members in groups.values():
        for (t, p, *_), ranges in zip(members, substring_dedup.covered_starts([m[2:] for m in members], window), strict=True):
            got |= {(t, p + i) for a, b in ranges for i in range(a, b + 1)}
    seen = Counter(x[i : i + window] for x in texts for i in range(len(x) - window + 1))
    assert got == {(t, i) for t, x in enumerate(texts) for i in range(len(x) - window + 1) if seen[x[i : i + window]] > 1}


@given(st.lists(st.text("ab", max_size=400), max_size=4), st.integers(34, 40), st.integers(33, 40), st.integers(41, 120))
@settings(max_examples=60, deadline=None)
def test_runs_of_both_sizes(texts, window, passage, most):
    """Every window of either size stands in one run, whose anchor is its own, wherever a text is parted."""
    rolling = substring_dedup.Rolling()
    passage = min(window, passage)
    for text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        starts, anchors = {window: [], passage: []}, {window: {}, passage: {}}
        for place, gram, _, n, at, _, n_short, at_short in substring_dedup.runs_of_both(data, window, passage, rolling, most):
            assert n or n_short
            sides = {window: (n, at), passage: (n_short, at_short)} if window > passage else {window: (n, at)}
            for size, (count, anchor) in sides.items():
                starts[size] += range(place - anchor, place - anchor + count)
                for i in range(count):
                    anchors[size].setdefault(text[place - anchor + i : place - anchor + i + size], set()).add((gram, anchor - i))
        for size in starts:
            assert sorted(starts[size]) == list(range(max(0, len(text) - size + 1)))
            assert all(len(x) == 1 for x in anchors[size].values())


@pytest.mark.parametrize(("source", "group_runs"), [("odd_docs", 50_000), ("documents", 50_000), ("documents", 1)])
def test_passages_beside_removal(request, source, group_runs):
    docs = request.getfixturevalue(source)
    rows = docs.collect()
    texts = [r["text"] for r in rows]
    both = zip(rows, brute.removed(texts, 400), brute.removed(texts, 200), strict=True)
    expected = sorted(((r["doc_id"], *x, y[2], y[1]) for r, x, y in both), key=repr)
    got = substring_dedup.removal_digest(docs, group_runs=group_runs, passage=200)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "n_passage_bytes"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected


def test_query_counts_passages_of_fifty_words(spark, tmp_path):
    """Passages of 51 to 60 words in two texts are too short to be removed, but counted; other texts have none."""
    rng = np.random.default_rng(5)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(3, 7))) for _ in range(n))
    passages = [prose(n) for n in range(51, 61)]
    texts = [f"{prose(80)} {p} {prose(70)}" for p in passages for _ in range(2)] + [prose(400) for _ in range(20)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in QUERIES["op2_substring_dedup"](spark, str(tmp_path)).collect()}
    for i, (text, plain) in enumerate(zip(texts, brute.removed(texts, 400), strict=True)):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == plain and r["n_bytes"] == len(text)
        if i < 20:
            assert r["n_removed"] == 0 and r["n_passages"] == 1
            assert 0 <= r["n_passage_bytes"] - len(passages[i // 2]) <= 10
        else:
            assert r["n_passages"] == r["n_passage_bytes"] == 0


def test_trimmed_documents(odd_docs):
    cut = substring_dedup.trimmed_documents(odd_docs)
    assert cut.columns == odd_docs.columns and cut.count() == odd_docs.count()
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert texts[1] == "" and texts[2] == "" and texts[5] is None and texts[8]
    assert substring_dedup.trimmed_documents(odd_docs.where("false")).count() == 0


def test_near_classes(documents):
    expected = brute.near_classes([(r["doc_id"], r["text"]) for r in documents.collect()])
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.class_of_documents(documents).collect()}
    assert got == expected


def test_near_classes_odd(odd_docs):
    rows = near_dedup.class_of_documents(odd_docs).collect()
    got = defaultdict(set)
    for r in rows:
        got[r["doc_id"]].add(r["class_id"])
    assert len(rows) == odd_docs.count()
    assert got[1] == got[2] == got[3] == {1} and all(got[i] == {i} for i in (4, 5, 6, 7, 8))
    kept = near_dedup.distinct_documents(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 3
    assert near_dedup.class_of_documents(odd_docs.where("false")).count() == 0


def test_near_hot_bucket(spark, monkeypatch):
    """Members far from the bucket's centre still find each other, across blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 3)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(24):
        words = list(base)
        for at in rng.choice(100, i % 8, replace=False):
            words[at] = f"x{i // 2}y{at}"
        rows.append((i, " ".join(words)))
    passage = " ".join(f"p{i}" for i in range(40))
    rows += [(100 + i, passage + " " + " ".join(f"q{i // 2}z{k}" for k in range(30 + i % 2))) for i in range(14)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.class_of_documents(docs).collect()}
    assert got == brute.near_classes(rows)


def test_near_moved_and_repeated(spark):
    """Sets of shingles are alike, whatever the order and the number of repeats."""
    rows = []
    for i in range(0, 40, 2):
        parts = [" ".join(f"r{i}p{p}w{w}" for w in range(40)) for p in range(25)]
        rows += [(i, " ".join(parts)), (i + 1, " ".join(parts[::-1]))]
    for i in range(40, 80, 2):
        parts = [" ".join(f"r{i}p{p}w{w}" for w in range(100)) for p in range(4)]
        rows += [(i, " ".join(parts)), (i + 1, " ".join(p for p in parts for _ in range(6)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute.near_classes(rows)
    assert expected == {i: i - i % 2 for i in range(80)}
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.class_of_documents(docs).collect()} == expected


def test_overlap_bound():
    """The bound of the overlap never drops a pair that is alike."""
    rng = np.random.default_rng(5)
    for n in (1, 2, 5, 40, 3000, 20000):
        base = rng.integers(0, 2**63, n, dtype=np.uint64)
        bags = [base] + [np.concatenate([base[int(n * cut) :], rng.integers(0, 2**63, new, dtype=np.uint64)]) for cut in (0, 0.1, 0.2, 0.5) for new in (0, n // 9, n)]
        bits, sizes = near_dedup.bitmaps(bags), np.array([len(b) for b in bags])
        may = near_dedup.may_overlap(bits[0], n, bits, sizes)
        real = [near_dedup.overlap(base, b) >= near_dedup.SIMILAR for b in bags]
        assert all(m or not r for m, r in zip(may, real, strict=True))
        assert n > 5000 or n < 40 or list(may) == real


def test_members_with_partners():
    """No member of a pair that the sets or the labelled shingles link is left out, whatever its bitmap's width."""
    rng = np.random.default_rng(9)
    group, bags = [], []
    for i in range(150):
        n = int(rng.integers(20, 300))
        if i % 3:
            base = bags[-1]
            kept = base[rng.random(len(base)) < rng.choice([0.75, 0.85, 0.95])]
            bag = np.concatenate([kept, rng.integers(0, 2**63, int(rng.integers(0, 20)), dtype=np.uint64)])
        else:
            bag = rng.integers(0, 2**63, n, dtype=np.uint64)
        if i % 5 == 0:
            bag = np.concatenate([bag, bag[: len(bag) // 2]])
        offsets = np.array([0, len(bag)])
        nth = near_dedup.occurrences(bag, offsets)
        labels = near_dedup.labelled(bag, nth)
        once, again = labels[nth == 0], bool(nth.any())
        bits = [near_dedup.bitmap(x, near_dedup.width(len(x))).tobytes() for x in (once, labels)]
        group.append((0, i, i, len(once), len(labels), np.array([7, 8]), bits[0], bits[1] if again else None))
        bags.append(bag)
    once = [np.unique(b) for b in bags]
    every = [near_dedup.labelled(b, near_dedup.occurrences(b, np.array([0, len(b)]))) for b in bags]
    linked = {
        i for a in range(150) for b in range(a)
        if max(near_dedup.overlap(once[a], once[b]), near_dedup.overlap(every[a], every[b])) >= near_dedup.SIMILAR
        for i in (a, b)
    }
    got = near_dedup.with_partner(group, 7)
    assert len(linked) > 20 and linked <= got < set(range(150))
    # a pair is looked at in the first bucket it shares
    assert not near_dedup.with_partner(group, 8)


@given(st.lists(st.integers(0, 4), max_size=14), st.lists(st.integers(0, 4), max_size=14), st.integers(0, 20))
@settings(max_examples=300, deadline=None)
def test_alignment(a, b, band):
    common = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            common[i + 1][j + 1] = common[i][j] + 1 if x == y else max(common[i][j + 1], common[i + 1][j])
    edits = len(a) + len(b) - 2 * common[-1][-1]
    runs = near_dedup.matched_runs(a, b, band)
    assert (runs is None) == (edits > band)
    if runs is not None:
        assert sum(runs) == common[-1][-1]


def test_alignment_memory(monkeypatch):
    """The trace does not keep a table for every edit; sets that link a pair need no alignment."""
    band = 1500
    a, b = list(range(2000)), list(range(5000, 7000))
    tracemalloc.start()
    assert near_dedup.matched_runs(a, b, band) is None
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4e6
    assert near_dedup.matched_runs([*range(20), 98, *range(30, 40)], [*range(20), 99, *range(30, 40)], 4) == (8, 22)
    monkeypatch.setattr(near_dedup, "matched_runs", None)
    text = np.arange(1000, dtype=np.uint64)
    assert near_dedup.alike((text, text, text), (text[::-1], text[::-1], text))


def test_source_mix_goes_on(spark, monkeypatch):
    """Sources not done by Newton steps are halved on, and never pass in silence."""
    cells = spark.createDataFrame([("a", 1, 50), ("a", 90, 3), ("b", 7, 20), ("b", 4000, 2)], "source string, size long, n long").coalesce(1).cache()
    targets = source_mix.source_targets(cells).coalesce(1).cache()
    monkeypatch.setattr(source_mix, "STEPS", 1)
    monkeypatch.setattr(source_mix, "HALVINGS", 1)
    with pytest.raises(RuntimeError):
        source_mix.multipliers(cells, targets)
    monkeypatch.setattr(source_mix, "HALVINGS", 80)
    for r in source_mix.multipliers(cells, targets).collect():
        own = [c for c in cells.collect() if c["source"] == r["source"]]
        have = sum(c["n"] * c["size"] * min(2.0, np.exp(min(r["lam"] * c["size"] / r["mean"], 1.0))) for c in own)
        assert r["done"] and (source_mix.CAP * r["source_size"] * (1 - 1e-9) <= r["target"] or abs(have - r["target"]) <= 1e-6 * r["target"])


@pytest.mark.parametrize("source", ["odd_docs", "documents"])
def test_source_mix(request, source):
    docs = request.getfixturevalue(source)
    rows = source_mix.mix_counts(docs.select("doc_id", "text", "source")).collect()
    words = [(r["doc_id"], len(brute.BLANK_WORD.findall(r["text"] or "")), r["source"]) for r in docs.collect()]
    total, smallest = Counter(), {}
    for _, n, s in words:
        total[s] += n
        smallest[s] = min(n or 10**9, smallest.get(s, 10**9))
    expected = brute.targets({s: total[s] for _, _, s in words})
    by_size = Counter((i, n, total[s], round(expected[s], 3)) for i, n, s in words)
    assert Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 3)) for r in rows) == by_size
    assert all(r["taken"] == r["copies"] * r["size"] <= 2 * r["size"] for r in rows)
    if source == "documents":
        source_of = {i: s for i, _, s in words}
        taken = Counter()
        for r in rows:
            taken[source_of[r["doc_id"]]] += r["taken"]
        assert all(abs(taken[s] - expected[s]) <= max(60, 0.02 * expected[s]) for s in expected)
        again = source_mix.mix_counts(docs.select("doc_id", "text", "source").repartition(5)).collect()
        assert Counter(map(tuple, again)) == Counter(map(tuple, rows))


def test_source_targets_of_many_sources(spark):
    """Sources by the thousand, sizes over many magnitudes: the targets of resharing round by round."""
    rng = np.random.default_rng(3)
    sizes = {f"host{i}\u00e9" if i % 2 else f"Host {i}": int(10 ** rng.uniform(0, 7)) for i in range(5000)}
    sizes |= {None: 12345, "": 7, "empty": 0}
    cells = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, size long, n long").repartition(8)
    got = {r["source"]: r["target"] for r in source_mix.source_targets(cells).collect()}
    want = brute.targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - t) <= 1e-9 * t for s, t in want.items())
    none = spark.createDataFrame([("a", 0, 3), (None, 0, 1)], cells.schema)
    assert {r["source"]: r["target"] for r in source_mix.source_targets(none).collect()} == {"a": 0.0, None: 0.0}
    plan = source_mix.numbered(cells.select("source")).orderBy("place").collect()
    assert [r["place"] for r in plan] == list(range(len(sizes))) and plan[-1]["source"] is None
    assert [r["source"].encode() for r in plan[:-1]] == sorted(s.encode() for s in sizes if s is not None)


def test_source_mix_documents(odd_docs):
    mixed = source_mix.mixed_documents(odd_docs)
    assert mixed.columns == odd_docs.columns and mixed.count() > 0
    assert source_mix.mixed_documents(odd_docs.where("false")).count() == 0


def test_top_k_odd(spark):
    rows = [
        (0, [0.5, -0.5]), (0, [0.5, -0.5]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]),
        (6, [float("inf"), 1.0]), (7, []), (8, [1.0, 2.0, 3.0]), (10, [-1.0, 0.1]), (50, [1.0, 2.0, 1.0]), (100, [-0.5, -0.5]), (None, [1.0, 1.0]),
    ]
    df = spark.createDataFrame(rows, "id long, vector array<double>").where("id IS NOT NULL")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in top_k.top_k(df, df["id"] % 50 == 0, k=2).collect()}
    assert got == {
        (0, 1): (1, 0), (0, 2): (2, 0), (50, 1): (8, 256 * 256 * 8), (100, 1): (10, 128 * 256 - 128 * 25), (100, 2): (0, 0),
    }
    assert top_k.top_k(df.where("false"), df["id"] % 50 == 0).count() == 0


def test_top_k_large_components(spark):
    """Scores beyond 2**53 are exact; those beyond a long stop the query."""
    rng = np.random.default_rng(5)
    cells = rng.integers(-(2**28), 2**28, (40, 4))
    cells[1], cells[2] = cells[0] + [0, 0, 0, 1], cells[0]
    rows = [(i, [float(c) / 256 for c in v]) for i, v in enumerate(cells)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    got = [tuple(r) for r in top_k.top_k(df, df["id"] % 20 == 0).orderBy("query_id", "rank").collect()]
    want = []
    for q in (0, 20):
        scored = sorted((-sum(int(a) * int(b) for a, b in zip(cells[q], v, strict=True)), i) for i, v in enumerate(cells) if i != q)
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:5], 1)]
    assert got == want and max(s for *_, s in got) > 2**53
    # whole blocks stay exact up to the bound of a long
    with pytest.raises(Exception, match="may not fit a long"):
        top_k.top_k(spark.createDataFrame([(0, [2.0**40]), (1, [2.0**40])], df.schema), F.col("id") == 0).collect()


def test_top_k_repeated_id_with_other_vectors(spark):
    """Each vector of a repeated id is a query of its own; none is a candidate of its id."""
    df = spark.createDataFrame([(0, [1.0]), (0, [-1.0]), (1, [2.0]), (2, [-2.0])], "id long, vector array<double>")
    got = sorted(tuple(r) for r in top_k.top_k(df, df["id"] == 0, k=1).collect())
    assert got == [(0, 1, 1, 2 * 65536), (0, 1, 2, 2 * 65536)]


def test_top_k_in_many_cells(spark, monkeypatch):
    """Many blocks of several lengths, with vectors far larger in some blocks than in the others."""
    monkeypatch.setattr(top_k, "BLOCK", 16)
    monkeypatch.setattr(top_k, "CELL", 2)
    rng = np.random.default_rng(8)
    vectors = [rng.normal(size=8 if i % 7 else 3) * (30 if i // 50 == 3 else 1) for i in range(500)]
    vectors[41] = vectors[40]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, vector array<double>").repartition(3)
    got = [tuple(r) for r in top_k.top_k(df, df["id"] % 4 == 0).orderBy("query_id", "rank").collect()]
    cells = [np.floor(256 * v).astype(int) for v in vectors]
    want = []
    for q in range(0, 500, 4):
        scored = sorted((-int(cells[q] @ v), i) for i, v in enumerate(cells) if i != q and len(v) == len(cells[q]))
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:5], 1)]
    assert got == want


def test_top_k_broadcasts_no_blocks(spark, monkeypatch):
    """Blocks that are sent to many cells are small as files and large as rows; none goes through the driver."""
    monkeypatch.setattr(top_k, "BLOCK", 16)
    monkeypatch.setattr(top_k, "CANDIDATE_BYTES", 1 << 10)
    df = spark.range(400).selectExpr("id", "array(double(id % 9), double(id % 7)) AS vector")
    plan = top_k.top_k(df, df["id"] % 4 == 0)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and "Broadcast" not in plan


def test_top_k_grid_is_bounded_in_bytes():
    """Neither side is copied more often than the other side's bytes ask for, beside what keeps the cores busy."""
    mb = 1 << 20
    assert top_k.grid((0, 0), (0, 0), 6) == (1, 1)
    assert top_k.grid((1, mb), (27, 7 * mb), 6) == (1, 7)
    rows, columns = top_k.grid((150, 38 * mb), (7500, 1900 * mb), 6)
    assert (rows, columns) == (2, 30)
    assert columns * 38 + rows * 1900 < 6 * 1024


def test_top_k_of_narrow_and_wide_blocks():
    for largest, width in ((2**15 - 1, 2), (2**15, 4), (2**31 - 1, 4), (2**31, 8), (2**60, 8)):
        cells = np.array([[0.0, -largest], [largest, 1.0]])
        kept = top_k.narrowed(cells)
        assert kept.itemsize == width and (top_k.unpacked(kept.tobytes(), width, 2) == cells).all()
