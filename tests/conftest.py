import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    home = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(home / "shared")).config("spark.sql.warehouse.dir", str(home / "warehouse")).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return str(DATA)


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def shown(x):
    import numpy as np

    if x is None or (isinstance(x, float) and np.isnan(x)) or str(x) == "NaT":
        return None
    if isinstance(x, bool | np.bool_ | int | np.integer):
        return int(x)
    if isinstance(x, float | np.floating) or hasattr(x, "as_tuple"):
        return int(x) if float(x).is_integer() else round(float(x), 6)
    if isinstance(x, list | np.ndarray):
        return tuple(map(shown, x))
    return str(x)


@pytest.fixture(scope="session")
def same(spark, duck, sf_dir):
    """Holds a query's rows against its SQL's."""

    def check(run, sql):
        a, b = run(spark, sf_dir).toPandas(), duck.sql(sql).df()
        assert sorted(a.columns) == sorted(b.columns)
        rows = [sorted((tuple(map(shown, r)) for r in d[sorted(d.columns)].itertuples(index=False)), key=repr) for d in (a, b)]
        assert rows[0] == rows[1]

    return check
