"""Stand-in inputs built from the driver tables.

The reference runs on hospital tables (stays, admissions, persons, charted
events, diagnosis codes) that are not public.  These functions only reshape
the driver's tables into those schemas -- they do none of the operators'
work -- so every operator runs on data that grows with the scale factor:

* event timeline: stay = ``events.user_id``; intime = hour of the first event,
  outtime = last event; measurements = (event_type, value);
* order stays: stay = admission = order, subject = customer; intime =
  ``o_orderdate``, outtime = last ``l_shipdate``; a "death" time from returned
  lines; birth date by a fixed rule on ``c_custkey``;
* code sets: the distinct part brands of an order;
* predictions: logits = first 10 embedding entries, candidates = the label and
  its two neighbours mod 10 (none for every seventh vector).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourglass.functions.columns import hour_floor

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Fixed values of the event mapping (parameters of the stand-in, not results).
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
FEATURES = ("click", "error", "purchase", "signup", "view", "refund")  # "refund" never occurs
STATE_EVENTS = ("purchase", "error")
GRID_HOURS = 720
SEQ_LEN = 120


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def event_stays(events: DataFrame) -> DataFrame:
    """One stay per user: intime = hour of first event, outtime = last event."""
    s = events.groupBy("user_id").agg(F.min("ts").alias("__first"), F.max("ts").alias("outtime"))
    return s.select("user_id", hour_floor("__first").alias("intime"), "outtime")


def order_stays(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Stay = order: intime = order date, outtime = last ship date, death = last returned ship + 3 d."""
    ships = lineitem.groupBy("l_orderkey").agg(
        F.max("l_shipdate").alias("outtime"),
        F.max(F.when(F.col("l_returnflag") == "R", F.col("l_shipdate"))).alias("__ret"))
    o = orders.join(ships, orders.o_orderkey == ships.l_orderkey, "inner")
    return o.select(
        F.col("o_orderkey").alias("ICUSTAY_ID"), F.col("o_orderkey").alias("HADM_ID"),
        F.col("o_custkey").alias("SUBJECT_ID"), F.col("o_orderdate").alias("INTIME"),
        F.col("outtime").alias("OUTTIME"),
        F.timestamp_add("DAY", F.lit(3), F.col("__ret")).alias("DEATHTIME"),
        F.col("o_orderpriority").alias("ADMISSION_TYPE"))


def birth_date(custkey) -> "F.Column":
    """Fixed rule: 1930-01-01 + (key * 7919 mod 30000) days + (key mod 24) hours."""
    k = F.col(custkey) if isinstance(custkey, str) else custkey
    base = F.expr("TIMESTAMP_NTZ'1930-01-01 00:00:00'")
    return F.timestamp_add("HOUR", k % 24, F.timestamp_add("DAY", (k * 7919) % 30000, base))


def persons(customer: DataFrame, nation: DataFrame) -> DataFrame:
    c = customer.join(F.broadcast(nation.select("n_nationkey", "n_name")),
                      customer.c_nationkey == nation.n_nationkey, "left")
    return c.select(F.col("c_custkey").alias("SUBJECT_ID"), birth_date("c_custkey").alias("DOB"),
                    F.col("n_name").alias("ETHNICITY"), F.col("c_mktsegment").alias("INSURANCE"),
                    F.col("c_acctbal").alias("ACCTBAL"))


def order_brands(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """Long (order, code) rows: each line's part brand."""
    return (lineitem.select("l_orderkey", "l_partkey")
            .join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"), "inner")
            .select(F.col("l_orderkey").alias("o_orderkey"), F.col("p_brand").alias("code")))


def predictions(embeddings: DataFrame) -> DataFrame:
    """(id, logits, candidates, label) from embeddings."""
    lab = F.col("label")
    cands = F.when(F.col("vec_id") % 7 == 0, F.array().cast("array<int>")).otherwise(
        F.array(lab, (lab + 1) % 10, (lab + 9) % 10).cast("array<int>"))
    return embeddings.select(
        F.col("vec_id").alias("id"),
        F.slice(F.col("embedding"), 1, 10).cast("array<double>").alias("logits"),
        cands.alias("candidates"),
        lab.cast("int").alias("label"))


def binary_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Two-class probabilities [1 - s, s] with s = (n_chars mod 97) / 97, ties on purpose."""
    s = (F.col("n_chars") % 97) / F.lit(97.0)
    d = documents.select("doc_id", s.alias("__s"))
    return labels.join(d, ["doc_id"], "inner").select(
        "doc_id", F.col("quality").alias("label"), F.col("toxic"),
        F.array(F.lit(1.0) - F.col("__s"), F.col("__s")).alias("probs"))
