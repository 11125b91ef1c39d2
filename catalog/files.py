"""Round trips through the file formats."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from casebook.operators.sizing import shared_folder
from casebook.sources import files
from catalog.registry import query, table

CUSTOMER = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


def _folder(spark) -> str:
    """A fresh folder that all executors can reach."""
    return f"{shared_folder(spark)}/files-{uuid4().hex}"


@query("SELECT * FROM customer")
def csv_round_trip(spark, folder):
    path = f"{_folder(spark)}/customer"
    files.write_csv(table(spark, folder, "customer"), path)
    return files.read_csv(spark, path, CUSTOMER)


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_mktsegment FROM customer")
def pipe_round_trip(spark, folder):
    path = f"{_folder(spark)}/customer"
    customer = table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment")
    files.write_csv(customer, path, sep=files.PIPE)
    return files.read_delimited(spark, path)


@query("SELECT * FROM supplier")
def parquet_round_trip(spark, folder):
    path = f"{_folder(spark)}/supplier"
    files.write_parquet(table(spark, folder, "supplier"), path, n_files=4, partition_by=["s_nationkey"])
    return files.read_parquet(spark, path).select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")


@query("SELECT c_acctbal AS prediction FROM customer")
def headerless_scores(spark, folder):
    path = f"{_folder(spark)}/scores"
    files.write_csv(table(spark, folder, "customer").select(F.col("c_acctbal")), path, header=False)
    return files.read_csv(spark, path, "prediction double", header=False)


@query("""SELECT o_orderkey, o_totalprice AS prediction, (o_orderkey % 3)::INTEGER AS fold FROM orders""")
def read_fold_scores(spark, folder):
    base = _folder(spark)
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", (F.col("o_orderkey") % 3).alias("f"))
    paths = [f"{base}/fold_{i}" for i in range(3)]
    for i, path in enumerate(paths):
        files.write_csv(orders.filter(F.col("f") == i).drop("f"), path)
    return files.read_fold_scores(spark, paths, "o_orderkey bigint, prediction double")
