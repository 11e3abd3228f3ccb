import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def payments(spark):
    """Make payments from (customer, id, time, amount, recipient, city) rows."""

    def make(rows):
        full = [(*row, *["R", "X"][len(row) - 4 :]) for row in rows]
        schema = (
            "customer_id string, transaction_id string, timestamp string, amount double, "
            "recipient_entity string, city string"
        )
        from txnlens.schema import canonical

        return canonical(spark.createDataFrame(full, schema))

    return make


@pytest.fixture
def by_id():
    """Collect one column by transaction id."""

    def collect(df, column):
        return {row["transaction_id"]: row[column] for row in df.select("transaction_id", column).collect()}

    return collect
