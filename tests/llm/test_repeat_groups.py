"""Maximal repeat groups against every pair of contexts and every place of every string."""

import random
from collections import defaultdict

import brute
import pytest

from scenara.llm import repeat_groups as rg
from scenara.llm.substring_dedup import common


def by_pairs(lefts, rights, least):
    out, n = set(), range(len(lefts))
    for i in n:
        for j in range(i):
            left, right = common(lefts[i], lefts[j]), common(rights[i], rights[j])
            if left + right >= least:
                same = [m for m in n if common(lefts[m], lefts[i]) >= left and common(rights[m], rights[i]) >= right]
                out.add((left, right, tuple(same)))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_groups_of_an_array(seed):
    rand = random.Random(seed)
    text = lambda: bytes(rand.choice(b"ab") for _ in range(rand.randrange(6)))
    pairs = [(text(), b"k" + text()) for _ in range(rand.randrange(2, 14))]
    lefts, rights = [p for p, _ in pairs], [q for _, q in pairs]
    got = [(left, right, tuple(sorted(m))) for left, right, m in rg.maximal_groups(lefts, rights, 2)]
    assert len(got) == len(set(got))
    assert set(got) == by_pairs(lefts, rights, 2)


WINDOW = 60


@pytest.fixture(scope="module")
def texts():
    rand = random.Random(5)
    prose = lambda n: " ".join(rand.choice(["sea", "ünï", "wind", "stone", "light", "riverside"]) + str(rand.randrange(10_000)) for _ in range(n))
    shared, other = prose(40), prose(12)
    out = [f"{prose(8)} {shared} {prose(5)}" for _ in range(4)] + [f"{prose(3)} {shared[:200]} {other} {prose(3)} {other}" for _ in range(3)]
    return [*out, out[0], out[0], "x" * 200, "", None, prose(30)]


def occurrences(raws, piece):
    return {(i, at) for i, raw in enumerate(raws) for at in range(len(raw) - len(piece) + 1) if raw.startswith(piece, at)}


@pytest.mark.parametrize("group_runs", [rg.GROUP_RUNS, 0])
def test_all_occurrences(spark, texts, group_runs):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = rg.repeat_groups(docs, WINDOW, group_runs).collect()
    raws = [(t or "").encode() for t in texts]
    groups = defaultdict(set)
    covered = [set() for _ in texts]
    for r in found:
        groups[r["group_id"]].add((r["doc_id"], r["start"], r["length"]))
        covered[r["doc_id"]].update(range(r["start"], r["start"] + r["length"]))
    for places in groups.values():
        doc, start, length = next(iter(places))
        piece = raws[doc][start : start + length]
        assert len(piece) == length >= WINDOW
        assert {(d, s) for d, s, _ in places} == occurrences(raws, piece) and len(places) > 1
    assert [len(c) for c in covered] == [n for _, n, *_ in brute.removed(texts, WINDOW)]


def test_odd_rows(spark, odd_docs):
    found = rg.repeat_groups(odd_docs).collect()
    assert {r["doc_id"] for r in found} == {1, 2, 3, 7}
    assert rg.repeat_groups(odd_docs.where("false")).count() == 0
