import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture()
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def same():
    """Compares a DataFrame with a DuckDB result, columns by name and rows in any order."""

    def rows(pdf):
        pdf = pdf[sorted(pdf.columns)]
        return sorted((tuple(map(_plain, r)) for r in pdf.astype(object).where(pdf.notna(), None).values.tolist()), key=repr)

    def _plain(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, list):
            return tuple(map(_plain, v))
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    def check(df, relation):
        got, want = rows(df.toPandas()), rows(relation.fetchdf())
        assert len(got) == len(want)
        assert got == want

    return check
