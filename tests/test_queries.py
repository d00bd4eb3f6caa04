"""Every registered query of the engine against its SQL on the smallest tables."""

import os
import sys

import duckdb
import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__  # noqa: E402
from spanlake.plans import registry  # noqa: E402

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
registry.load()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def canon(df):
    def value(v):
        if not hasattr(v, "__len__") and pd.isna(v):
            return None
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        return round(float(v), 6) if isinstance(v, (int, float, np.integer, np.floating)) else str(v)

    df = df[sorted(df.columns)]
    return list(df.columns), sorted((tuple(map(value, r)) for r in df.itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    assert canon(registry.QUERIES[name](spark, DATA).toPandas()) == canon(duck.execute(registry.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_whole_texts_are_collapsed(spark, tmp_path):
    texts = ["  a \t b\n" * 200 + " end ", "x\u00a0\u2003y", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.collapsed for r in registry.QUERIES["p4_collapsed_texts"](spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else " ".join(t.split()) for i, t in enumerate(texts)}


def test_passages_of_few_words_are_found(spark, tmp_path):
    words = [f"w{i}" for i in range(14)]
    texts = ["pre " + " ".join(words) + ", post", "ab" * 20, "one two", " ".join(words[:9]) + ". " + " ".join(words[:9]) + "!", "none of these"]
    passages = [" ".join(words[:n]) for n in range(1, 14)] + ["aba", "ne two", "7 w8 w", "absent", "of these and"]
    for name, column, rows in (("documents", "doc_id", texts), ("benchmark", "item_id", passages)):
        spark.createDataFrame(list(enumerate(rows)), f"{column} long, text string").coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {(r.doc_id, r.item_id, r.n) for r in registry.QUERIES["o14_multi_pattern_search"](spark, str(tmp_path)).collect()}
    assert got == {(i, j, t.count(p)) for i, t in enumerate(texts) for j, p in enumerate(passages) if p in t}


@pytest.mark.parametrize("name", ["g10_a4_mask_groups", "g10_a6_skipped", "r1_masked_text"])
def test_plans_equal_their_sql_where_a_private_address_looks_like_an_insurance_number(spark, tmp_path, name):
    spark.createDataFrame([(25432,), (10300,), (8,)], "c_custkey long").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    assert canon(registry.QUERIES[name](spark, str(tmp_path)).toPandas()) == canon(c.execute(registry.ORACLES[name]).df())
