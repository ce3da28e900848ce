"""Survey-shaped views of order data: every order is a response of the customer who placed it.

All views are lazy selects over the given Parquet tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import FINISHED, IN_PROGRESS, INITIAL_LOAD, UNTREATED
from ..scratch import dealt, small_table

VARIABLES = (("quantity", "int", 1), ("price", "number", 2), ("lines", "integer", 3), ("flag", "string", 4))


def _cents(column: str) -> Column:
    """Sum of an amount with two decimals, added up in whole cents: longs, not decimals."""
    total = F.sum(F.round(F.col(column) * 100).cast("bigint"))
    return (total.cast("decimal(20,0)") / 100).cast("decimal(38,2)")


class SurveyViews:
    """The views over one folder of source tables."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def receipts(self) -> DataFrame:
        status = F.col("o_orderstatus")
        return self.source("orders").select(
            F.year("o_orderdate").alias("period"), F.col("o_custkey").cast("string").alias("unit"),
            F.col("o_orderpriority").alias("form"), F.col("o_orderkey").cast("string").alias("ref"),
            F.col("o_orderdate").alias("received_at"), (status == "F").alias("edited"),
            (status != "P").alias("active"),
            F.when(status == "F", FINISHED).when(status == "O", UNTREATED).otherwise(IN_PROGRESS).alias("status"),
        )

    def units(self) -> DataFrame:
        """The frame: every customer in every year between the first and the last order."""
        years = self.source("orders").agg(
            F.sequence(F.min(F.year("o_orderdate")), F.max(F.year("o_orderdate"))).alias("y")
        ).scalar()
        return self.source("customer").select(
            F.explode(years).alias("period"), F.col("c_custkey").cast("string").alias("unit"),
            F.concat(F.col("c_mktsegment"), F.lit(", N-"), F.col("c_nationkey").cast("string")).alias("form"),
        )

    def unit_info(self) -> DataFrame:
        nation = self.source("nation")
        wide = self.source("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
            F.col("c_custkey").cast("string").alias("unit"), F.col("c_name").alias("name"),
            F.col("c_mktsegment").alias("segment"),
            F.concat(
                F.lpad(F.col("n_regionkey").cast("string"), 2, "0"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")
            ).alias("municipality"),
        )
        return wide.unpivot(["unit"], ["name", "segment", "municipality"], "variable", "value")

    def observations_wide(self) -> DataFrame:
        """One row per response with its values as text columns."""
        per_order = self.source("lineitem").groupBy("l_orderkey").agg(
            _cents("l_quantity").cast("string").alias("quantity"),
            _cents("l_extendedprice").cast("string").alias("price"),
            F.count("*").cast("string").alias("lines"),
            # The largest of one-letter flags, by code: a number keeps the aggregate hash-based.
            F.char(F.max(F.ascii("l_returnflag"))).alias("flag"),
        )
        orders = self.source("orders").select(
            F.year("o_orderdate").alias("period"), F.col("o_orderpriority").alias("form"),
            F.col("o_custkey").cast("string").alias("unit"), "o_orderkey",
        )
        return orders.join(per_order, F.col("o_orderkey") == F.col("l_orderkey")).select(
            "period", "form", "unit", F.col("o_orderkey").cast("string").alias("ref"),
            *[name for name, _, _ in VARIABLES],
        )

    def observations(self) -> DataFrame:
        return self.observations_wide().unpivot(
            ["period", "form", "unit", "ref"], [name for name, _, _ in VARIABLES], "variable", "value"
        )

    def receipts_quarterly(self) -> DataFrame:
        """Receipts with two period columns, the year and the quarter of the receipt."""
        rows = self.receipts().withColumn("quarter", F.quarter("received_at"))
        return rows.withColumnRenamed("period", "year")

    def observations_quarterly(self) -> DataFrame:
        when = self.receipts_quarterly().select("ref", "year", "quarter")
        return self.observations().drop("period").join(when, "ref")

    def types(self) -> DataFrame:
        return small_table(self.spark, VARIABLES, "variable string, datatype string, rowno int")

    def ledger(self) -> DataFrame:
        """Line amounts by line number as accounts, beside the stated total."""
        lines = self.source("lineitem").groupBy("l_orderkey", "l_linenumber").agg(
            _cents("l_extendedprice").alias("amount")
        ).select(F.col("l_orderkey").alias("seq"), F.col("l_linenumber").cast("string").alias("account"), "amount")
        totals = self.source("orders").select(
            F.col("o_orderkey").alias("seq"), F.lit("total").alias("account"),
            F.col("o_totalprice").cast("decimal(38,2)").alias("amount"),
        )
        return lines.unionByName(totals)

    def chart_ledger(self) -> DataFrame:
        """Line amounts on four-digit accounts 1000 to 8999, by part.

        Hardly two lines share an account, so the lines themselves are dealt by submission:
        their sums and those of the submissions then need no further shuffle.
        """
        code = F.lit(1000) + (F.col("l_partkey") * 37) % 8000
        lines = self.source("lineitem").select(
            F.col("l_orderkey").alias("seq"), code.cast("string").alias("account"), "l_extendedprice")
        return dealt(lines, "seq").groupBy("seq", "account").agg(_cents("l_extendedprice").alias("amount"))

    def versions(self) -> DataFrame:
        return self.source("orders").select(
            F.col("o_custkey").cast("string").alias("unit"), F.year("o_orderdate").alias("period"),
            F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 9 + 1).cast("int").alias("version_no"),
            F.col("o_orderdate").alias("received_at"),
        )

    def update_counts(self) -> DataFrame:
        """Edits per version: its returned lines."""
        return self.source("lineitem").where(F.col("l_returnflag") == "R").groupBy(
            F.col("l_orderkey").alias("seq")
        ).agg(F.count("*").alias("n_changes"))

    def comments(self) -> DataFrame:
        general = F.col("event_type").isin("signup", "error")
        return self.source("events").select(
            F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("unit"),
            F.when(general, "general").otherwise("variable").alias("level"),
            F.when(~general, F.col("event_type")).alias("variable"), F.col("props").alias("comment"),
            F.lit(1).alias("version"), (F.col("value") > 10).alias("active"), F.col("ts").alias("created_at"),
            F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("created_by"),
        )

    def changes(self) -> DataFrame:
        """Change history: sign-ups stand for the initial load."""
        return self.source("events").select(
            F.col("user_id").cast("string").alias("ref"), F.col("event_type").alias("variable"),
            F.col("value").cast("string").alias("new_value"), F.col("ts").alias("changed_at"),
            F.when(F.col("event_type") == "signup", INITIAL_LOAD).otherwise("editering").alias("process_type"),
            F.col("event_id").alias("hist_id"),
        )
