import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
os.environ["PYTHONPATH"] = f"{ROOT}:{ROOT}/tests:{ROOT}/tests/llm:{os.environ.get('PYTHONPATH', '')}"
sys.path.insert(0, ROOT)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidemark.session import build_session

    shared = tmp_path_factory.mktemp("shared")
    session = build_session(
        "tests", "local[8]", 8,
        {"spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": f"file://{shared}", "spark.sql.warehouse.dir": str(shared / "warehouse")},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.fixture(scope="session")
def same(duck):
    """Whether a DataFrame holds the rows of a query in DuckDB, columns by name, in any order."""
    from collections import Counter

    def check(df, sql):
        found = duck.execute(sql)
        names = [d[0] for d in found.description]
        rows = df.toArrow()
        assert sorted(names) == sorted(rows.column_names)
        expected = Counter(found.fetchall())
        got = Counter(zip(*[rows[c].to_pylist() for c in names], strict=True)) if rows.num_rows else Counter()
        assert got == expected, (list((expected - got).items())[:3], list((got - expected).items())[:3])

    return check
