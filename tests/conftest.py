import os
import sys
import uuid

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from hireatlas.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return configure(session)


@pytest.fixture
def folder(tmp_path):
    return lambda name: str(tmp_path / f"{name}-{uuid.uuid4().hex[:6]}")


@pytest.fixture(scope="session")
def rows(spark):
    """Frame from DDL and dict rows."""

    def make(ddl, data):
        names = [part.strip().split()[0] for part in _split(ddl)]
        return spark.createDataFrame([tuple(row.get(n) for n in names) for row in data], ddl)

    return make


def _split(ddl):
    depth, part, out = 0, "", []
    for ch in ddl:
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and depth == 0:
            out.append(part)
            part = ""
        else:
            part += ch
    return [*out, part]
