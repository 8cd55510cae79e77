"""The domain's tables as views over the driver's: see each function for what stands for what."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.session import spread


class Views:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def nodes(self) -> DataFrame:
        """Topics are customers, facts orders; the case is the customer's nation."""
        c = self.table("customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("long").alias("case_id"), "c_mktsegment")
        topics = c.select("case_id", F.concat(F.lit("c:"), "k").alias("id"), F.lit("topic").alias("type"), F.lit("activated").alias("status"), F.lower("c_mktsegment").alias("memory"), F.lit("").alias("key"), F.array(F.lower("c_mktsegment")).alias("tags"), F.lit(None).cast("timestamp_ntz").alias("chat_time"))
        o = self.table("orders").join(c.withColumnRenamed("k", "o_custkey"), "o_custkey")
        band = F.when(F.col("o_totalprice") < 100000, "budget purchase now").when(F.col("o_totalprice") < 200000, "weekly schedule changed").otherwise("favorite place")
        status = F.when(F.col("o_orderstatus") == "F", "archived").otherwise("activated")
        facts = o.select("case_id", F.concat(F.lit("o:"), "o_orderkey").alias("id"), F.lit("fact").alias("type"), status.alias("status"), F.concat_ws(" ", F.lit("plan"), band, F.lower("o_orderpriority")).alias("memory"), F.col("o_orderstatus").alias("key"), F.array(F.lower("o_orderpriority"), F.lower("c_mktsegment")).alias("tags"), F.col("o_orderdate").alias("chat_time"))
        return topics.unionByName(facts)

    def edges(self) -> DataFrame:
        """PARENT from customer to order (odd orders the other way), MERGED_TO from an order to the customer's next."""
        c = self.table("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("case_id"))
        o = self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate").join(c, "o_custkey")
        customer, order = F.concat(F.lit("c:"), "o_custkey"), F.concat(F.lit("o:"), "o_orderkey")
        odd = F.col("o_orderkey") % 2 == 1
        parent = o.select("case_id", F.when(odd, order).otherwise(customer).alias("source"), F.when(odd, customer).otherwise(order).alias("target"), F.lit("PARENT").alias("type"))
        following = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
        merged = o.withColumn("n", following).where("n is not null").select("case_id", order.alias("source"), F.concat(F.lit("o:"), "n").alias("target"), F.lit("MERGED_TO").alias("type"))
        return parent.unionByName(merged)

    def memories(self) -> DataFrame:
        """Memory nodes are documents; each rests on its source, tags are language and source, every tenth is archived."""
        return spread(self.table("documents")).select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.array("lang", "source").alias("tags"), F.array("source").alias("provenance"), F.when(F.col("doc_id") % 10 == 9, "archived").otherwise("active").alias("status"), "n_chars")

    def queries(self) -> DataFrame:
        return self.table("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))

    def edits(self) -> DataFrame:
        """Edits are a user's events in order of time."""
        op = F.when(F.col("event_type").isin("signup", "purchase"), "add").when(F.col("event_type") == "click", "merge").when(F.col("event_type") == "error", "delete").otherwise("noop")
        seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
        return self.table("events").select(F.col("user_id").alias("case_id"), seq.cast("long").alias("seq"), op.alias("op"), "event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))

    def rewards(self) -> DataFrame:
        return self.table("events").select("event_id", F.col("user_id").alias("uid"), F.col("value").alias("score"), (F.col("event_type") != "error").alias("available"))

    def rounds(self) -> DataFrame:
        day = F.to_date("ts")
        return self.table("events").groupBy(F.col("user_id").alias("case_id"), day.alias("round")).agg((F.count_if(F.col("event_type") == "error") == 0).alias("saturated"))
