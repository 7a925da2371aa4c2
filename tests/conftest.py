import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [str(ROOT), os.environ.get("PYTHONPATH")]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sql():
    """Run SQL over the tables of a folder, or over given frames."""
    import duckdb

    def run(text, folder=None, **frames):
        con = duckdb.connect()
        for path in sorted(Path(folder).glob("*.parquet")) if folder else []:
            con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
        for name, frame in frames.items():
            con.register(name, frame)
        return con.execute(text).fetchall(), [d[0] for d in con.description]

    return run


@pytest.fixture(scope="session")
def same_rows(sql):
    """Assert that a DataFrame has the rows of a SQL query, whatever the order of rows and columns."""

    def check(df, text, folder=None, **frames):
        rows, names = sql(text, folder, **frames)
        assert sorted(df.columns) == sorted(names)
        order = sorted(names)
        plain = lambda v: round(v, 8) if isinstance(v, float) else v
        mine = sorted(repr(tuple(plain(r[c]) for c in order)) for r in df.collect())
        theirs = sorted(repr(tuple(plain(r[names.index(c)]) for c in order)) for r in rows)
        assert mine == theirs

    return check
