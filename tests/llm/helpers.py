"""Small tables with everything that may go wrong in them."""

import duckdb

from paperfold.llm.common import prepared

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n bigint, id bigint, bucket string, kind string, size bigint, length bigint, host string, path string"


def table(spark, rows):
    """(doc_id, text) rows with further columns, some of them null and with names that operators use inside."""
    prepared(spark)
    full = [(i, t, "en", "s", len(t or ""), 1, 2, "b", "k", 3, 4, None, "p") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


LONG = "word " * 60_000
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (6, LONG), (None, "one two"), (7, "a b c"), (8, "A b\tC")]


def texts(folder, limit=None):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet' ORDER BY doc_id").fetchall()
    return rows[:limit]
