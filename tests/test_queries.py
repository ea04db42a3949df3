"""Every registered query of the retrieval engine against DuckDB."""

import math

import duckdb
import pytest

from turnstone.plans.oracles import ORACLES
from turnstone.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    value = lambda x: (None if math.isnan(x) else round(x, 9)) if isinstance(x, float) else x
    return sorted((tuple(value(r[k]) for k in order) for r in rows), key=repr)


def test_all_queries_have_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(result.fetchall(), columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())


def test_glossary_of_letters_that_fold_to_others(spark, tmp_path):
    texts = ["SS ß ss stra\u00dfe STRASSE", "ΟΔΟΣ οδοσ οδος e\u0301 \u00e9 É İ i", "", " a\x0bb a\u00a0b\fA  ", "𐐀 𐐨", None]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    con.execute(f"create view benchmark as select * from '{tmp_path}/benchmark.parquet/*.parquet'")
    found = QUERIES["glossary_terms"](spark, str(tmp_path))
    assert canonical([tuple(r) for r in found.collect()], found.columns) == canonical(con.execute(ORACLES["glossary_terms"]).fetchall(), ["pos", "term"])
