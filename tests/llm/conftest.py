
import duckdb
import pytest

LONG = "lorem ipsum dolor sit amet " * 3000
PROSE = " ".join(f"word{i} stands{i % 7} here{i % 11}" for i in range(120))


@pytest.fixture(scope="session")
def odd_rows():
    """Missing values, empty, blank and very long texts, ties and repeated rows."""
    edited = PROSE.replace("word50", "changed")
    return [
        (1, PROSE, "en", "a", len(PROSE)),
        (1, PROSE, "en", "a", len(PROSE)),
        (2, PROSE, "en", "a", len(PROSE)),
        (3, edited, "en", None, len(edited)),
        (4, "", "en", "b", 0),
        (5, None, None, "b", None),
        (6, " \t\n\r\x0b\x0c ", None, None, 7),
        (None, "no id here, MIT  License!", "en", "b", 25),
        (7, LONG, "de", "c", len(LONG)),
        (8, "ünïcödé Apache-License\nGENERAL public license mit license mit license", "fr", "c", 66),
        (9, "a<|endoftext|>b  <|endoftext|>\x1c\x85 　x", None, "é", 30),
        (10, "12 34 -- !!", "en", "d", 11),
        (11, "dup line\ndup line\n\ndup line\n", "en", "d", 27),
        (12, "SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0 WITH LLVM-exception\n", "en", "d", 80),
        (13, "SPDX-License-Identifier: AND (\n", "en", "d", 30),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The rows with extra columns whose names clash with those of operators."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    base = spark.createDataFrame(odd_rows, schema)
    names = ["k1", "k2", "rank", "size", "n", "target", "copies", "failed", "kept", "token", "block", "id", "runs", "class_id", "n_words", "score"]
    names += ["_size", "_k", "_rank", "_salt", "_row", "_n", "_mix", "_s", "_z", "_c", "_k1", "_k2", "_ledger_", "row", "ledger", "a.b"]
    for name in names:
        base = base.selectExpr("*", f"'x' AS `{name}`")
    return base


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con

