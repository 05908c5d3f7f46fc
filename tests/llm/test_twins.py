import duckdb
import pytest

from quillmere.llm import queries

TABLES = "documents embeddings pages benchmark labels".split()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows(name, spark, sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf).toPandas(), c.execute(queries.ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(tuple(map(str, r)) for r in df[sorted(df.columns)].astype({k: float for k, v in df.dtypes.items() if v.kind in "if"}).itertuples(index=False))
    assert rows(got) == rows(want)
