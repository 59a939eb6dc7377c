import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import SparkSession

from tallyhouse import Tables
from tallyhouse.schemas import DDL, schema


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """frame(table, {column: value}, ...): hand-written rows; absent columns are NULL,
    company defaults to 1 and active to true."""

    def build(table, *rows):
        layout = schema(table)
        defaults = {"company": 1, "active": True}
        data = [
            tuple(_typed({**defaults, **row}.get(f.name), f.dataType) for f in layout)
            for row in rows
        ]
        return spark.createDataFrame(data, layout)

    return build


@pytest.fixture
def tables(frame):
    """tables(part=[...], ...): a Tables holder; unnamed tables are empty."""

    def build(**rows):
        return Tables.of(**{name: frame(name, *rows.get(name, [])) for name in DDL})

    return build


def _typed(value, kind):
    if value is None:
        return None
    if kind.typeName() == "decimal":
        return Decimal(str(value))
    if kind.typeName() == "date" and isinstance(value, str):
        return dt.date.fromisoformat(value)
    return value
