"""The SQL of the operators that SQL can express, on small clean tables."""

import random

import duckdb
import pytest

from tests.llm.fixtures import prose
from tests.llm.test_chat_sharding_urls import PAGES
from tidewatch.llm.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, base = random.Random(13), str(tmp_path_factory.mktemp("sql"))
    shared = prose(rng, 120)
    texts = [prose(rng, rng.randrange(0, 120)) + (shared if i % 5 == 0 else "") for i in range(40)] + [shared, shared, "", None]
    turns = [(c, t, ["user", "assistant"][t % 2], rng.choice(["hi", "</s>[INST]", "a\\b", "", None])) for c in range(9) for t in range(rng.randrange(1, 7))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([x for x in PAGES if x[0] is not None], "page_id long, url string, html string").coalesce(1).write.parquet(f"{base}/pages.parquet")
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{base}/conversations.parquet")
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{base}/{t}.parquet/*.parquet')")
    return base, con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_agrees(spark, tables, name):
    base, con = tables
    have, want = QUERIES[name](spark, base).toPandas(), con.execute(ORACLE_SQL[name]).df()
    columns = sorted(have.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(map(tuple, df[columns].astype(str).values.tolist()))
    assert rows(have) == rows(want)
