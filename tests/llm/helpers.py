"""Brute-force versions that the operators are held against."""

import duckdb
import pandas as pd
from pyspark.sql import types as T

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def oracle(sql, sf_dir, documents=None):
    """The SQL's rows over the tables of a folder, or over other documents (a pandas frame) beside them."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    if documents is not None:
        con.execute("DROP VIEW documents")
        con.register("documents", documents)
    return con.execute(sql).df()


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(None if x is None or x is pd.NA or x != x else x for x in r) for r in frame.astype(object).itertuples(index=False)), key=repr)


def same(found, want):
    assert sorted(found.columns) == sorted(want.columns)
    assert rows(found) == rows(want)


def docs(spark, *data, extra=False):
    """A documents table of (doc_id, text), with language, source and, if asked, columns with clashing names."""
    fields = [("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType())]
    more = ["n", "d1", "node", "tiles", "tokens", "domain", "copies", "budget", "__x", "held_out", "score", "hash", "last", "place", "__tm_doc", "__tm_drop", "__TM_GONE", "__tm_text", "key", "row", "rare"] if extra else []
    schema = T.StructType([T.StructField(n, k) for n, k in fields] + [T.StructField(n, T.StringType()) for n in more])
    out = [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else "src1", None if t is None else len(t), *["x"] * len(more)) for k, (i, t) in enumerate(data)]
    return spark.createDataFrame(out, schema)
