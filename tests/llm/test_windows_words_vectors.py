"""Benchmark windows, spelling variants and clusters against brute force, and on odd input."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import brute
from scenara.llm import catalog, clustering, decontamination, spelling


def words(text):
    return brute.WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def contaminated(docs, items, size, share=1.0):
    """For each document: words, hit words, ids of items with occurring windows."""
    windows = []
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        windows += [(item, w[i : i + n]) for i in range(len(w) - n + 1)] if n else []
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, window in windows:
            n, k = len(window), min(3, len(window))
            need = math.ceil((n - k + 1) * share)
            for i in range(len(w) - n + 1):
                if share == 1 and w[i : i + n] != window:
                    continue
                if sum(w[i + j : i + j + k] == window[j : j + k] for j in range(n - k + 1)) >= need:
                    hit |= set(range(i, i + n))
                    found |= {str(item)} if item is not None else set()
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


ITEMS = [
    (1, "The quick brown fox jumps over the lazy dog while it rains in the old town"),
    (1, "another text of the item that has the same id as the first one here"),
    (2, "short one"),
    (3, "solo"),
    (4, "a b a b a b a b a b a b a b"),
    (5, ""),
    (6, None),
    (None, "windows of an item without id mark the words but are not listed"),
    (7, "ÜBER straße ÉTÉ"),
    (10, "the quick brown fox jumps over the lazy dog while it rains in the old town"),
]
DOCS = [
    (1, "Before: the QUICK brown fox, jumps over the lazy dog; while it rains in the old town! After"),
    (1, "Before: the QUICK brown fox, jumps over the lazy dog; while it rains in the old town! After"),
    (2, "the quick brown fox jumps over the lazy"),
    (3, "this is a short one and a solo and a short one"),
    (4, "a b " * 40),
    (5, ""),
    (6, None),
    (None, "windows of an item without id mark the words"),
    (7, "ÜBER straße ÉTÉ und über straße été"),
    (8, "the quick brown fox leaps over the lazy dog while it rains in the old town"),
    (9, "lorem ipsum " * 1000 + "short one"),
    (10, "solo"),
    (11, "brown fox jumps over the lazy dog while it rains in the"),
]


@pytest.mark.parametrize("share", [1.0, 0.6])
def test_contamination(spark, rows, share):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "'x' AS k1", "'x' AS words", "'x' AS item_id", "'x' AS `a.b`")
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "'x' AS shingle", "'x' AS window")
    got = decontamination.digest(decontamination.contamination(docs, items, share=share))
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = spark.createDataFrame(contaminated(DOCS, ITEMS, 10, share), got.schema)
    assert rows(got, *cols) == rows(want, *cols)


def test_contamination_of_tables(spark, documents, sf_dir, rows):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = catalog.op11_decontamination(spark, sf_dir)
    some = [(r["doc_id"], r["text"]) for r in documents.collect() if len(r["text"] or "") < 2000]
    want = {r[0]: r for r in contaminated(some, items, 10)}
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    found = {r[0]: r for r in rows(got, *cols)}
    assert len(found) == documents.count() and {k: found[k] for k in want} == want


def test_contamination_without_rows(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontamination.contamination(docs.where("false"), items).count() == 0
    assert decontamination.contamination(docs, items.where("false")).where("contaminated").count() == 0


def test_contamination_without_broadcast(spark, rows):
    """The merge joins that a large benchmark takes give the same rows, and no Python runs."""
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = decontamination.digest(decontamination.contamination(docs, items))
        plan = got._jdf.queryExecution().executedPlan().toString()
        cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
        assert rows(got, *cols) == rows(spark.createDataFrame(contaminated(DOCS, ITEMS, 10), got.schema), *cols)
        assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


RUN = re.compile("[A-Za-zÀ-ÿ]+")


def vocabulary(docs):
    count = Counter()
    for doc, text in docs:
        for run in RUN.findall(text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(count):
    """Every word's row, from all deletions and masks of all words."""
    meet = {}
    for w in count:
        for i in range(len(w)):
            meet.setdefault((w[:i], w[i + 1 :]), set()).add(w)
            meet.setdefault(w[:i] + w[i + 1 :], set()).add(w)
        meet.setdefault(w, set()).add(w)
    near = {w: set() for w in count}
    for group in meet.values():
        for a in group:
            near[a] |= {b for b in group if a != b and b not in near[a] and one_edit(a, b)}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-count[x], x), default=None)
        form[w] = best if best is not None and count[best] >= 5 * count[w] else None
    out = []
    for w, n in count.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), count[form[w]] if form[w] else None))
    return out


VARIANTS = ["word", "form", "root", "n", "n_near", "form_n"]


def test_variants_of_table(spark, documents, rows, sf_dir):
    count = vocabulary([(r["doc_id"], r["text"]) for r in documents.collect()])
    got = rows(catalog.op12_spelling_variants(spark, sf_dir), *VARIANTS)
    want = variants(count)
    assert len(want) > 500 and sorted(map(repr, got)) == sorted(map(repr, want))


def test_variants_of_odd_rows(spark, odd_docs, odd_rows, rows):
    """Chains of forms, ties, words of many thousands of letters, missing values."""
    long = "ab" * 5000
    texts = ["letters " * 200 + "lettera " * 30 + "letterà " * 6 + "etters " * 7 + "leetters " * 7 + "xetters " * 7, f"{long} " * 30 + f"{long}c " * 5, "×÷×÷×÷ " * 5]
    extra = [(100 + i, t, None, None, None) for i, t in enumerate(texts)]
    docs = odd_docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)
    got = rows(spelling.variants(docs), *VARIANTS)
    want = variants(vocabulary([(r[0], r[1]) for r in [*odd_rows, *extra]]))
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert spelling.variants(docs.where("false")).count() == 0


def test_every_near_pair_shares_a_merged_list():
    """The bounds hold, also with a dictionary that has most grams and with one that has none."""
    rng = random.Random(5)
    for keep in (0.0, 0.3, 0.9):
        seen = {}

        class Dictionary(dict):
            def __contains__(self, gram):
                return seen.setdefault(gram, rng.random() < keep)  # noqa: B023

            def get(self, gram, default=None):
                return zlib.crc32(gram.encode()) % 50

        lists = {}

        def merged(word):
            if word not in lists:  # noqa: B023
                s = spelling.padded(word)
                grams = spelling.decomposed(s, Dictionary())  # noqa: B023
                most = spelling.affected(grams, len(word))
                assert most < len(grams)
                ranked = sorted((Dictionary().get(s[a : a + q]), s[a : a + q], a) for a, q in grams)  # noqa: B023
                lists[word] = [(g, a) for _, g, a in ranked[: most + 1]]  # noqa: B023
            return lists[word]  # noqa: B023

        for _ in range(4000):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(6, 12)))
            i = rng.randrange(len(word) + 1)
            other = rng.choice([word[:i] + rng.choice("abc") + word[i:], word[:i] + "d" + word[i + 1 :]])
            a, b = sorted((word, other), key=len)
            shifts = (0,) if len(a) == len(b) else (0, 1)
            assert {(g, p + d) for g, p in merged(a) for d in shifts} & set(merged(b)), (a, b)


def test_long_lists_are_cut_into_blocks(spark, documents, rows, sf_dir, monkeypatch):
    monkeypatch.setattr(spelling, "LIST_BLOCK", 3)
    monkeypatch.setattr(spelling, "ROW_BATCH", 50)
    monkeypatch.setattr(spelling, "EXTENDED", 50)
    want = variants(vocabulary([(r["doc_id"], r["text"]) for r in documents.collect()]))
    assert sorted(map(repr, rows(spelling.variants(documents), *VARIANTS))) == sorted(map(repr, want))


def lloyd(vectors, k, rounds):
    """Plain k-means in Python integers: cluster, distance by vector, and centroids."""
    whole = [[math.floor(1024 * x) for x in v] for _, v in vectors]
    hashed = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), v, w) for (i, v), w in zip(vectors, whole, strict=True))
    centroids = [w for *_, w in hashed[:k]]
    for step in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(w, c, strict=True)), j) for j, c in enumerate(centroids)) for w in whole]
        if step < rounds:
            for j in range(len(centroids)):
                own = [w for w, (_, i) in zip(whole, near, strict=True) if i == j]
                if own:
                    centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    inertia = Counter()
    for d, j in near:
        inertia[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, j, d, inertia[j], sum(inertia.values()), sha[j]) for (i, _), (d, j) in zip(vectors, near, strict=True)]


CLUSTERS = ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.mark.parametrize(("k", "rounds"), [(1, 3), (2, 4), (7, 6), (40, 10), (3, 0), (500, 2)])
def test_clusters(spark, rows, k, rounds, monkeypatch):
    rng = np.random.default_rng(k)
    points = (rng.integers(-3, 4, (120, 5)) / 4 + rng.integers(0, 4, (120, 1))).tolist()
    vectors = [*((i if i % 9 else None, p) for i, p in enumerate(points)), (5, points[5]), (5, points[6]), (7, points[7])]
    odd = [(900, None), (901, [1.0] * 4), (902, [1.0, None, 1.0, 1.0, 1.0]), (903, [1.0, float("nan"), 1.0, 1.0, 1.0]), (904, [float("inf")] * 5), (905, [])]
    df = spark.createDataFrame([*vectors, *odd], "id long, vector array<double>").selectExpr("*", "'x' AS h", "'x' AS sums", "'x' AS cluster")
    got = clustering.cluster(df.repartition(5), "id", "vector", k, 5, rounds)
    want = spark.createDataFrame(lloyd(vectors, k, rounds), got.schema)
    assert rows(got, *CLUSTERS) == rows(want, *CLUSTERS)


def test_clusters_of_odd_tables(spark):
    df = spark.createDataFrame([(1, [0.5, 2.0**40])], "id long, vector array<double>")
    assert clustering.cluster(df.where("false"), "id", "vector", 3, 2, 5).count() == 0
    with pytest.raises(Exception, match="might not fit"):
        clustering.cluster(df, "id", "vector", 3, 2, 5).collect()


def test_shallot_equals_full_search():
    rng = np.random.default_rng(1)
    for k in (2, 3, 9, 60):
        at = rng.integers(-9, 10, (k, 3))
        at[-1] = at[0]  # two equal centroids
        x = rng.integers(-12, 13, (3000, 3))
        a = rng.integers(0, k, len(x))
        b = (a + rng.integers(1, k, len(x))) % k
        near, second, d1, d2 = clustering.shallot(x, a, b, clustering.Centroids(at))
        full = ((x[:, None] - at[None]) ** 2).sum(2)
        order = np.sort(full, axis=1)
        assert (near == full.argmin(1)).all() and (d1 == order[:, 0]).all() and (d2 == order[:, 1]).all() and (near != second).all()
