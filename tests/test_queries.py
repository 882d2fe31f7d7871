"""Every query with an oracle gives the oracle's rows; the others run."""

import duckdb
import pandas as pd
import pytest

from tracemill.plans import ORACLES, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(sf_small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_small}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    plain = lambda x: None if x is None or x is pd.NA or x != x else round(float(x), 7) if isinstance(x, float) else x
    return sorted((tuple(plain(x) for x in r) for r in frame.astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, sf_small, duck):
    found = QUERIES[name](spark, sf_small).toPandas()
    if name not in ORACLES:
        assert len(found)
        return
    want = duck.execute(ORACLES[name]).df()
    assert sorted(found.columns) == sorted(want.columns)
    assert rows(found) == rows(want)


def test_languages_of_short_and_blank_texts(spark, tmp_path):
    """Lengths whose quarter is no whole number, and texts of white space beyond ASCII's."""
    texts = [None, "", " \n", *("a" * n for n in range(1, 13)), *("1" * n for n in range(1, 8)), "가가가aa가", "\u3000", "\xa0 \u2003", "\x1c"]
    data = pd.DataFrame({"doc_id": range(4 * len(texts)), "text": [t for t in texts for _ in range(4)], "lang": "en", "source": "s"})
    data.to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.register("documents", data)
    found = QUERIES["think_languages"](spark, str(tmp_path)).toPandas()
    assert rows(found) == rows(con.execute(ORACLES["think_languages"]).df())
