"""The driver's star schema as experiments: one hyperedge for each line item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat columns; Catalyst drops the joins' columns and files' columns that a query doesn't use.

    Line items meet their orders first, as numbers, before texts of parts, suppliers and customers hang on them, and each
    customer has met its orders before: so what is shuffled are narrow rows."""
    t = lambda name: table(spark, sf_dir, name)
    nation = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    supplier = t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("facility"), F.col("r_name").alias("facility_region"))
    customer = t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("c_name").alias("expert"), F.col("r_name").alias("geography"))
    orders = t("orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("evidence"), F.year("o_orderdate").cast("int").alias("year"), (F.col("o_orderstatus") == "P").alias("is_sensitive"))
    orders = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey", "c_custkey")
    part = t("part").select("p_partkey", F.col("p_brand").alias("material"), F.col("p_type").alias("process"), F.col("p_size").cast("int").alias("size"))
    money = lambda c: F.round(F.col(c) * 100).cast("long")
    items = t("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("quantity"), money("l_discount").alias("discount"), money("l_tax").alias("tax"), money("l_extendedprice").alias("price"),
        (1 - F.col("l_discount")).alias("confidence"), F.col("l_returnflag").alias("source_type"),
    )
    x = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return x.select(
        F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "quantity", "price"))).alias("id"),
        "material", "facility", "process", "facility_region", "quantity", "discount", "tax", "price", "size", "expert", "evidence", "year", "geography", "source_type", "confidence", "is_sensitive",
    )


#: The same in SQL, as a common table expression named x.
LINES_SQL = """x AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT), CAST(round(l_extendedprice * 100) AS BIGINT)) AS id,
    p_brand AS material, n.n_name AS facility, p_type AS process, r.r_name AS facility_region,
    CAST(l_quantity AS BIGINT) AS quantity, CAST(round(l_discount * 100) AS BIGINT) AS discount, CAST(round(l_tax * 100) AS BIGINT) AS tax, CAST(round(l_extendedprice * 100) AS BIGINT) AS price,
    p_size AS size, c_name AS expert, o_orderpriority AS evidence, CAST(year(o_orderdate) AS INT) AS year, cr.r_name AS geography,
    l_returnflag AS source_type, 1 - l_discount AS confidence, o_orderstatus = 'P' AS is_sensitive
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation n ON s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
    JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN region cr ON cn.n_regionkey = cr.r_regionkey)"""


def spread(rows: DataFrame, read: DataFrame) -> DataFrame:
    """rows dealt out by id if they are read by fewer tasks than there are cores; large tables stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, "id") if read.rdd.getNumPartitions() < cores else rows


def _entity(kind: str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), value.alias("value"))


def as_experiments(rows: DataFrame, *keep: str) -> DataFrame:
    """Rows of `lines` in the model's columns, with some columns kept beside them."""
    text = lambda name: F.concat(F.lit(f"{name}: "), F.col(name).cast("string"))
    relation = lambda s, kind, t: F.struct(F.col(s).alias("source"), F.lit(kind).alias("type"), F.col(t).alias("target"))
    return rows.select(
        *keep, "id", F.lit(0).cast("long").alias("ord"), F.col("id").alias("name"),
        F.array(_entity("Material", F.col("material")), _entity("Facility", F.col("facility")), _entity("Property", text("quantity")), _entity("Property", text("discount"))).alias("input_entities"),
        F.array(_entity("Process", F.col("process")), _entity("Equipment", F.concat(F.lit("band "), F.floor(F.col("size") / 10).cast("string")))).alias("process_entities"),
        F.array(_entity("Property", text("price")), _entity("Property", text("tax"))).alias("output_entities"),
        F.array(relation("process", "uses_material", "material"), relation("process", "located_at", "facility")).alias("relations"),
        F.array("evidence").alias("evidence"), "confidence", "year", "geography", "source_type", "is_sensitive",
    )


def experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hyperedges themselves, in the model's columns."""
    return as_experiments(spread(lines(spark, sf_dir), table(spark, sf_dir, "lineitem")))
