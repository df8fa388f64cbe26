import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[*]").appName("tests")
               .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "8g").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).config("spark.sql.session.timeZone", "America/New_York")
               .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def rows(spark):
    """Rows of a literal table: ``rows("a int, t string", [...])`` casts strings to the given types."""
    def make(schema: str, data: list):
        names = [part.strip().split(" ") for part in schema.split(",")]
        frame = spark.createDataFrame(
            [tuple(row) for row in data],
            ", ".join(f"{n} {'string' if t == 'timestamp_ntz' else t}" for n, t in names))
        return frame.selectExpr(*[f"CAST({n} AS {t}) AS {n}" for n, t in names])
    return make


def values(df, *order):
    """Rows as sorted tuples."""
    picked = df.select(*order) if order else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda t: tuple((x is None, str(type(x)), x) if x is not None else (True, "", 0) for x in t))


def plan(df, mode="formatted"):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))
