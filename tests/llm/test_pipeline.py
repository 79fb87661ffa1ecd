"""The corpus pipeline: every stage against brute force on what its predecessor kept."""

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from scenara.llm import license_scan, packing, quality_rules, substring_dedup, tokens


def kept_by_rules(text):
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words = brute.quality(text)[:5]
    n_lines = sum(bool(brute.BLANK_WORD.search(x)) for x in (text or "").split("\n"))
    return not (
        n_words < 50 or 100 * n_repeat_words > 50 * n_words or 100 * n_symbols > 5 * word_chars
        or 100 * n_dup_lines > 40 * n_lines or word_chars > 40 * n_words
    )


def test_stages(spark, documents, sf_dir, tmp_path):
    docs, stages = documents, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_dedup", "substring_dedup", "source_mix", "packing"]
    rows = docs.collect()

    def after(name):
        result = stages[name](spark, docs, sf_dir)
        path = str(tmp_path / name)
        result.write.parquet(path)
        return spark.read.schema(result.schema).parquet(path)

    docs = after("quality_rules")
    rows = [r for r in rows if kept_by_rules(r["text"])]
    assert docs.columns == documents.columns and sorted(docs.collect(), key=repr) == sorted(rows, key=repr) != []

    docs = after("near_dedup")
    classes = brute.near_classes([(r["doc_id"], r["text"]) for r in rows])
    rows = [r for r in rows if classes[r["doc_id"]] == r["doc_id"]]
    assert docs.columns == documents.columns and sorted(docs.collect(), key=repr) == sorted(rows, key=repr) != []

    docs = after("substring_dedup")
    got = {r["doc_id"]: r for r in docs.collect()}
    assert docs.columns == documents.columns and len(got) == len(rows)
    for r, (n_bytes, n_removed, *_) in zip(rows, brute.removed([r["text"] for r in rows], corpus_pipeline.PASSAGE_BYTES), strict=True):
        assert len((got[r["doc_id"]]["text"] or "").encode()) == n_bytes - n_removed

    before = Counter(got)
    docs = after("source_mix")
    copies = Counter(r["doc_id"] for r in docs.collect())
    assert docs.columns == documents.columns and set(copies) <= set(before) and 0 < max(copies.values()) <= 2

    packed = after("packing")
    library = tokens.library()
    ids = {i: np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4") for i, r in got.items()}
    assert Counter(r["doc_id"] for r in packed.where("piece = 0").collect()) == copies
    for r in packed.collect():
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]


def test_stage_finds_passages_of_fifty_words(spark, sf_dir):
    """Passages of 51 to 60 words in two otherwise different texts each go; texts of their own stay."""
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(3, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(n) for n in range(51, 61)]
    texts = [f"{prose(80)} {p} {prose(70)}" for p in passages for _ in range(2)]
    clean = [prose(400) for _ in range(20)]
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts + clean)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in dict(corpus_pipeline.STAGES)["substring_dedup"](spark, docs, sf_dir).collect()}
    for i, (_, text, *_) in enumerate(rows):
        if i < len(texts):
            assert passages[i // 2] not in got[i]["text"] and len(got[i]["text"]) < len(text) - 200
        else:
            assert got[i]["text"] == text
        assert got[i]["n_chars"] == len(got[i]["text"])


def test_repeated_strings_hold_only_runs_that_meet(spark, sf_dir, monkeypatch):
    """Runs whose anchor stands nowhere else are not counted by kind, sent or stored again."""
    rng = np.random.default_rng(9)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n))
    passage = prose(60)
    texts = [f"{prose(300)} {passage if i < 2 else prose(60)} {prose(300)}" for i in range(20)]
    rows, write = {}, substring_dedup.stored_at

    def counted(df, name):
        out = write(df, name)
        rows[name] = out[0].count()
        return out

    monkeypatch.setattr(substring_dedup, "stored_at", counted)
    monkeypatch.setattr(substring_dedup, "stored", lambda df, name: counted(df, name)[0])
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in dict(corpus_pipeline.STAGES)["substring_dedup"](spark, docs, sf_dir).collect()}
    assert all((t == got[i]) == (i > 1) and (passage in t) == (i < 2) and passage not in got[i] for i, t in enumerate(texts))
    assert rows["kinds"] < rows["runs"] / 10


def test_stages_keep_columns_of_any_name(spark, odd_docs, sf_dir):
    """What a stage keeps has the values it came with, whatever its columns are called."""
    docs = odd_docs.withColumn("text", F.when(F.col("doc_id") < 4, F.col("text")).otherwise(F.lit("line\n")))
    given = {tuple(r) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        result = stage(spark, docs, sf_dir)
        got = result.collect()
        assert result.columns == docs.columns and got, name
        if name != "substring_dedup":
            assert {tuple(r) for r in got} <= given, name
        else:
            assert {r[3:] for r in got} <= {r[3:] for r in given} or all(r["a.b"] == "x" for r in got), name


def test_stages_without_rows(spark, odd_docs, sf_dir):
    docs = odd_docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, sf_dir)
        assert result.count() == 0, name
    for result in (license_scan.scan_licenses(docs), quality_rules.ledger(docs), packing.pack(docs)):
        assert result.count() == 0
