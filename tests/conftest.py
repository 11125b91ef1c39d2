from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from oracle import database, session  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    spark = session(cores=4, partitions=4, spark_checkpoint_dir=str(tmp_path_factory.mktemp("shared")))
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def folder():
    return FOLDER


@pytest.fixture(scope="session")
def db(folder):
    return database(folder)


@pytest.fixture
def partitions(spark):
    """Set the number of shuffle partitions for one test."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", n)
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture
def everything_hot(monkeypatch):
    """Lower the bounds, so that small tables have hot keys and no small lookup tables."""
    from casebook.operators import sizing
    from catalog import fixtures

    monkeypatch.setattr(sizing, "HOT_ROWS", 0)
    monkeypatch.setattr(sizing, "HOT_SHARE", 1 / 600)
    monkeypatch.setattr(sizing, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(fixtures, "_hot", {})
