"""The driver's entry points, and queries against their SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from seqengine import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry(spark):
    assert entry.entry(spark).columns == ["user_id", "slot", "kind", "value"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(queries.queries()) <= set(entry.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows_of(df: pd.DataFrame) -> list[tuple]:
    plain = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, float) else str(v)
    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", ["dedup_mse_events", "dedup_ssim_vectors", "smooth_dedup", "cut_hold_split", "quality_alignment", "normalise_slow_range", "stream_gap_plan", "window_batches_100_50", "masked_interpolation", "sequence_gaps"])
def test_query_equals_its_sql(spark, duck, name):
    assert rows_of(queries.queries()[name](spark, SF).toPandas()) == rows_of(duck.sql(queries.oracle_sql()[name]).df())
