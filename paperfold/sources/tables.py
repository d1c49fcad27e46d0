"""Given tables and the domain tables derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperfold.functions import status as st
from paperfold.functions.pieces import split_with_offsets

NAMES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


class Tables:
    """Lazy access to the parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name not in NAMES:
            raise AttributeError(name)
        return self.spark.read.parquet(self.path(name))

    # ---- lifecycle -----------------------------------------------------
    def logs(self) -> DataFrame:
        """Extraction logs: one per order."""
        return self.orders.select(
            F.col("o_orderkey").alias("log_id"),
            F.col("o_custkey").alias("user_id"),
            (F.col("o_custkey") % 25).cast("int").alias("model_id"),
            st.from_order_status(F.col("o_orderstatus")).alias("status"),
            F.col("o_orderdate").alias("created_at"),
            F.col("o_totalprice").alias("amount"),
            F.col("o_orderpriority").alias("priority"),
        )

    def models(self) -> DataFrame:
        return self.nation.select(
            F.col("n_nationkey").alias("model_id"),
            F.col("n_name").alias("model_name"),
            F.col("n_regionkey").alias("tenant_id"),
        )

    def users(self) -> DataFrame:
        return self.customer.select(
            F.col("c_custkey").alias("user_id"),
            F.col("c_name").alias("user_name"),
            F.col("c_nationkey").alias("group_id"),
        )

    # ---- table rows ----------------------------------------------------
    ROW_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")

    # ---- text ----------------------------------------------------------
    def lines(self) -> DataFrame:
        """(doc_id, line_no, line): every line of every document, in order."""
        return self.documents.select(
            "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")
        )

    def words(self) -> DataFrame:
        """(doc_id, start, word): whitespace-separated words with character offsets."""
        return split_with_offsets(self.documents, "text", ["doc_id"], " ", "\n\r\t", piece="word", skip_empty=True)

    def placed_lines(self) -> DataFrame:
        """(doc_id, line_no, start, line): lines with their character offset in the document."""
        return split_with_offsets(self.documents, "text", ["doc_id"], "\n", index="line_no", piece="line")

    # ---- dictionary ----------------------------------------------------
    def dictionary(self) -> DataFrame:
        """One entry per distinct part name; the code is its smallest part key."""
        return (
            self.part.groupBy("p_name")
            .agg(F.min(F.struct("p_partkey", "p_type")).alias("m"))
            .select(
                F.col("m.p_type").alias("category"),
                F.col("m.p_partkey").cast("string").alias("code"),
                F.col("p_name").alias("name"),
            )
        )

    def chunk_results(self) -> DataFrame:
        """Partial results: one value per conversation turn."""
        n = F.length("text")
        return self.conversations.select(
            F.col("conv_id").alias("doc_id"),
            F.col("turn").alias("chunk_index"),
            F.col("role").alias("field_key"),
            F.when(n % 5 != 0, F.col("text")).alias("value"),
            ((n % 100) / 100).alias("confidence"),
            n.cast("bigint").alias("size"),
        )
