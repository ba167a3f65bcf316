import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from colloquy.session import build_session

DATA = "/root/testdata"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    conf = {
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "6g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("work")),
    }
    session = build_session("tests", "local[8]", **conf)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def ev(spark):
    """Evaluate Column builders over literal rows: ``ev(rows, ddl, col, ...)`` -> list of tuples."""

    def run(rows, ddl, *cols):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"__i int, {ddl}")
        got = df.select("__i", *[c.alias(f"c{i}") for i, c in enumerate(cols)]).collect()
        out = [tuple(r)[1:] for r in sorted(got, key=lambda r: r[0])]
        return [o[0] for o in out] if len(cols) == 1 else out

    return run
