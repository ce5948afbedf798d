import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cartloom.session import local_session  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "cartloom-tests", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def mart(spark, sf_dir):
    from cartloom.plans.mart import mart_for

    return mart_for(spark, sf_dir)


INVOICE_SCHEMA = (
    "Invoice string, StockCode string, Description string, Quantity int, InvoiceDate string, "
    "Price decimal(18,2), CustomerID bigint, Country string"
)


@pytest.fixture
def lines(spark):
    """Make invoice lines from short tuples; missing fields take a plain default."""
    from decimal import Decimal

    def make(rows):
        base = {
            "Invoice": "1001", "StockCode": "A1", "Description": "mug", "Quantity": 2,
            "InvoiceDate": "12/1/2010 8:26", "Price": Decimal("2.50"), "CustomerID": 7, "Country": "France",
        }
        full = []
        for r in rows:
            row = {**base, **r}
            if row["Price"] is not None:
                row["Price"] = Decimal(str(row["Price"]))
            full.append(tuple(row.values()))
        return spark.createDataFrame(full, INVOICE_SCHEMA)

    return make
