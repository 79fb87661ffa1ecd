"""License scan, quality rules, chat format and language ID."""

import math
import zlib

import pytest

import brute
from scenara.llm import chat_format, language_id, license_scan, quality_rules
from scenara.llm.catalog import ORACLE, QUERIES

BASE = ["n_words", "n_base", "first_word", "last_word", "base_labels"]


def by_id(df, *cols):
    return sorted(((r["doc_id"], *(r[c] for c in cols)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("source", ["odd_docs", "documents"])
def test_license_base(request, source):
    docs = request.getfixturevalue(source)
    expected = sorted(((r["doc_id"], *brute.base_licenses(r["text"])) for r in docs.collect()), key=repr)
    got = license_scan.scan_licenses(docs)
    assert by_id(got, *BASE) == expected
    for r in got.collect():
        assert 0 <= r["score"] <= 1 and set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""}


def test_license_expressions(odd_docs):
    rows = {r["doc_id"]: r for r in license_scan.scan_licenses(odd_docs).collect()}
    assert rows[12]["labels"] == "apache,gpl,mit" and rows[12]["permitted"]
    assert rows[12]["expressions"] == "mit gpl-2.0-only or apache-2.0 llvm-exception with and"
    assert rows[13]["expressions"] == "" and rows[13]["score"] == 0.5


@pytest.mark.parametrize(
    ("text", "expressions", "labels", "permitted"),
    [
        ("/* SPDX-License-Identifier: MIT */ x=1 /* SPDX-License-Identifier: GPL-3.0-only */", "mit; gpl-3.0-only", "gpl,mit", False),
        ("SPDX-License-Identifier: MIT SPDX-License-Identifier: (ISC OR MIT)", "mit; isc mit or", "isc,mit", True),
        ("# SPDX-License-Identifier: (MIT OR\r\n#   GPL-2.0-only)\nAND more", "mit gpl-2.0-only or", "gpl,mit", True),
        ("SPDX-License-Identifier: MIT\nOR GPL-2.0-only", "mit", "mit", True),
        ("SPDX-License-Identifier:\nMIT", "", "", None),
        ("SPDX-License-Identifier: (MIT\nSPDX-License-Identifier: ISC", "isc", "isc", True),
        ("spdxlicenseidentifier: MIT xspdx license identifier: ISC SPDX License Identifier: BSD-3-Clause", "bsd-3-clause", "bsd", True),
    ],
)
def test_license_tags(text, expressions, labels, permitted):
    got = license_scan.scan_text(text, license_scan.automaton())
    assert (got[7], got[5], got[8]) == (expressions, labels, permitted)


@pytest.mark.parametrize(
    ("text", "form", "value"),
    [
        ("MIT", ["mit"], True),
        ("GPL-3.0 OR MIT AND Apache-2.0", ["gpl-3.0", "mit", "apache-2.0", "and", "or"], True),
        ("(GPL-3.0 OR MIT) AND GPL-2.0", ["gpl-3.0", "mit", "or", "gpl-2.0", "and"], False),
        ("GPL-2.0 WITH Classpath-exception-2.0", ["gpl-2.0", "classpath-exception-2.0", "with"], False),
        ("MIT and more words", ["mit", "more", "and"], False),
        ("MIT */", ["mit"], True),
        ("MIT OR", None, None),
        ("(MIT", None, None),
        ("", None, None),
    ],
)
def test_shunting_yard(text, form, value):
    assert license_scan.postfix(text) == form
    if form:
        assert license_scan.evaluate(form)[0] is value


@pytest.mark.parametrize("source", ["odd_docs", "documents"])
def test_quality_measures(request, source):
    docs = request.getfixturevalue(source)
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    entries = quality_rules.ledger(docs)
    expected = sorted(((r["doc_id"], *brute.quality(r["text"])) for r in docs.collect()), key=repr)
    failed = quality_rules.passes(entries["failed"], quality_rules.BASE)
    assert by_id(entries.withColumn("base", ~failed), *cols, "base") == expected


def test_quality_policies(odd_docs):
    entries = quality_rules.ledger(odd_docs).cache()
    bits = [r["failed"] for r in entries.collect()]
    for policy in (quality_rules.BASE, quality_rules.CORPUS):
        got = {r["rule"]: r for r in quality_rules.ablations(entries, policy).collect()}
        for rule in quality_rules.RULES:
            if rule.name in policy.rules:
                own, bit = [b & policy.mask for b in bits], 1 << rule.bit
                r = got[rule.name]
                assert (r["failing"], r["failing_alone"], r["kept_without"]) == (
                    sum(b & bit > 0 for b in own), sum(b == bit for b in own), sum(b & ~bit == 0 for b in own))
    kept = quality_rules.kept_documents(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.count() == sum(b & quality_rules.CORPUS.mask == 0 for b in bits)
    entries.unpersist()


def test_quality_is_native(documents):
    plan = quality_rules.ledger(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "a </turn> b"), (1, 1, "assistant", "a </turn> b"),
    (2, None, None, None), (2, 0, "user: x", "### assistant: y</turn>\n### assistant: z"), (2, 1, "assistant", "\\\\ \\ <\\/turn> <\\c>"),
    (None, 3, "assistant", "</turn>\n"), (3, 0, "assistant", "x" * 200_000 + "</turn>\n" * 500), (4, 0, "</turn>\n:\\", ""),
]


def test_chat_round_trip(spark):
    rows = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    chats = {r["conv_id"]: r for r in chat_format.format_chats(rows).collect()}
    for conv, r in chats.items():
        key = lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")
        source = [(t[2] or "", t[3] or "") for t in sorted((t for t in TURNS if t[0] == conv), key=key)]
        assert r["identical"] and [(t["role"], t["text"]) for t in r["recovered"]] == source
    digests = {r["conv_id"]: r for r in chat_format.digest(chat_format.format_chats(rows)).collect()}
    assert digests[1]["loss_chars"] == 2 * len("a </turn> b") and digests[3]["loss_chars"] == 200_000 + 8 * 500
    assert digests[1]["formatted_chars"] == len(chats[1]["formatted"])
    assert chat_format.digest(chat_format.format_chats(rows.where("false"))).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    relation = duck.sql(ORACLE[name])
    assert sorted(relation.columns) == cols
    where = [relation.columns.index(c) for c in cols]
    expected = sorted(tuple(r[i] for i in where) for r in relation.fetchall())
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == expected


def test_language_held_out(documents):
    names, network = language_id.train(language_id.training_sample(documents))
    got = {r["doc_id"]: r for r in language_id.identify(documents, names, network).collect()}
    rows = [r for r in documents.collect() if r["lang"]]
    tested = [r for r in rows if got[r["doc_id"]]["held_out"]]
    right = sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in tested)
    assert tested and right >= 0.95 * len(tested)
    assert all(0 <= r["score"] <= 1 and not math.isnan(r["score"]) for r in got.values())


def test_language_equals_plain_loops(spark, documents):
    """Predictions against a forward pass written out value by value."""
    names, network = language_id.train(language_id.training_sample(documents))
    *filters, out, bias = network.weights
    texts = ["", "ok", "Straße über " * 3, "the cat sat on the mat. " * 30, "12 34", None, "a" * 256, "b" * 257]

    def forward(window):
        cells = [b + 32 if 65 <= b <= 90 else b for b in window] + [32] * (language_id.WINDOW - len(window))
        hidden = []
        for table in filters:
            width = len(table)
            for f in range(language_id.FILTERS):
                places = (sum(float(table[j][cells[i + j]][f]) for j in range(width)) for i in range(len(cells) - width + 1))
                hidden.append(max(0.0, max(places)))
        z = [sum(h * float(out[i][c]) for i, h in enumerate(hidden)) + float(bias[c]) for c in range(len(names))]
        e = [math.exp(v - max(z)) for v in z]
        return [v / sum(e) for v in e]

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(df, names, network).collect()}
    for i, text in enumerate(texts):
        if not any(c.isalpha() for c in text or ""):
            assert got[i] == ("und", 0.0)
            continue
        data = text.encode()
        mean = [0.0] * len(names)
        for a in range(0, len(data), language_id.WINDOW):
            window = data[a : a + language_id.WINDOW]
            mean = [m + p * len(window) / len(data) for m, p in zip(mean, forward(window), strict=True)]
        assert got[i][0] == names[mean.index(max(mean))]
        assert math.isclose(got[i][1], max(mean), abs_tol=1e-4)


def test_language_sample_takes_windows_of_whole_texts(spark):
    """The last window of a long text is learned from, and a short text; a repeated id keeps both languages."""
    long = "x" * 10_000 + "end"
    df = spark.createDataFrame([(i, t, lang) for i in range(20) for t, lang in ((long, "a"), ("hi", "b"))], "doc_id long, text string, lang string")
    sample = language_id.training_sample(df)
    assert {lang for lang, _ in sample} == {"a", "b"}
    assert ("a", long.encode()[-(len(long) % 256) :]) in sample and ("b", b"hi") in sample
    held = {i for i in range(20) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(lang == "b" for lang, _ in sample) == 20 - len(held)
    assert max(len(w) for _, w in sample) <= language_id.WINDOW


def test_language_odd(odd_docs):
    names, network = language_id.train(language_id.training_sample(odd_docs))
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.identify(odd_docs, names, network).collect()]
    assert len(got) == odd_docs.count()
    assert all(r[1:] == ("und", 0.0) for r in got if r[0] in (4, 5, 6, 10))
    assert all(r[1] in names for r in got if r[0] in (1, 7, 8))
    nothing = language_id.train(language_id.training_sample(odd_docs.where("false")))
    assert nothing == ([], None)
    assert {r["lang_pred"] for r in language_id.identify(odd_docs, *nothing).collect()} == {"und"}
    assert language_id.identify(odd_docs.where("false"), names, network).count() == 0
