"""Claims derived from the order tables: subject, relation, object, source, status, confidence, note."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["subject", "relation", "object", "source", "status", "confidence", "note"]
#: Relations whose objects are literals, and relations that may have one object.
ATTRIBUTES = ("ordered_on", "has_size", "has_total", "has_priority", "sold_as")
SINGLE_VALUED = ("has_priority", "in_nation", "has_size")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entity(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def _claims(df: DataFrame, subject: Column, relation: str, obj: Column, source: Column, key: Column) -> DataFrame:
    # both are looked up: queries read them several times a row, and a decimal made of a double each time was most of their work
    confidences = F.array(*[F.lit(f"{k / 100:.2f}") for k in range(101)])
    status = F.element_at(F.array(*[F.lit(s) for s in ("confirmed", "accepted", "needs_review", "candidate", "superseded")]), (key % 5 + 1).cast("int"))
    return df.select(subject.alias("subject"), F.lit(relation).alias("relation"), obj.alias("object"), source.alias("source"), status.alias("status"), F.element_at(confidences, (key % 101 + 1).cast("int")).alias("confidence"), F.lit("").alias("note"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {name: table(spark, sf_dir, name) for name in ("orders", "customer", "supplier", "nation", "part", "lineitem")}
    file = lambda name, key: F.concat(F.lit(f"sources/{name}_"), (F.col(key) % 97).cast("string"), F.lit(".md#row"), F.col(key).cast("string"))
    orders = t["orders"]
    parts = [
        _claims(orders, entity("order", "o_orderkey"), "placed_by", entity("customer", "o_custkey"), file("orders", "o_orderkey"), F.col("o_orderkey")),
        _claims(t["customer"], entity("customer", "c_custkey"), "in_nation", entity("nation", "c_nationkey"), file("customers", "c_custkey"), F.col("c_custkey")),
        _claims(t["supplier"], entity("supplier", "s_suppkey"), "in_nation", entity("nation", "s_nationkey"), file("suppliers", "s_suppkey"), F.col("s_suppkey")),
        _claims(t["nation"], entity("nation", "n_nationkey"), "in_region", entity("region", "n_regionkey"), file("nations", "n_nationkey"), F.lit(0)),
        _claims(orders, entity("order", "o_orderkey"), "ordered_on", F.to_date("o_orderdate").cast("string"), file("orders", "o_orderkey"), F.col("o_orderkey")),
        _claims(t["part"], entity("part", "p_partkey"), "has_size", F.col("p_size").cast("string"), file("parts", "p_partkey"), F.col("p_partkey")),
        _claims(orders, entity("order", "o_orderkey"), "has_total", F.col("o_totalprice").cast("decimal(18,2)").cast("string"), file("orders", "o_orderkey"), F.col("o_orderkey") + 1),
        _claims(orders, entity("customer", "o_custkey"), "has_priority", F.col("o_orderpriority"), file("orders", "o_orderkey"), F.col("o_orderkey")),
        _claims(t["lineitem"], entity("part", "l_partkey"), "sold_as", F.concat("l_returnflag", "l_linestatus"),
                F.concat(F.lit("sources/supplier_"), F.col("l_suppkey").cast("string"), F.lit(".md#line"), F.col("l_linenumber").cast("string")), F.col("l_orderkey")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _sql(frm: str, subject: str, relation: str, obj: str, source: str, key: str, where: str = "") -> str:
    return f"""SELECT {subject} AS subject, '{relation}' AS relation, {obj} AS object, {source} AS source,
      ['confirmed','accepted','needs_review','candidate','superseded'][CAST({key} % 5 AS INTEGER) + 1] AS status,
      CAST(CAST(({key} % 101) / 100 AS DECIMAL(3,2)) AS VARCHAR) AS confidence, '' AS note FROM {frm} {where}"""


def _file(name: str, key: str) -> str:
    return f"'sources/{name}_' || CAST({key} % 97 AS VARCHAR) || '.md#row' || CAST({key} AS VARCHAR)"


#: The same claims as the start of a WITH clause.
FACTS = "facts AS (\n" + "\nUNION ALL ".join([
    _sql("orders", "'order:' || o_orderkey", "placed_by", "'customer:' || o_custkey", _file("orders", "o_orderkey"), "o_orderkey"),
    _sql("customer", "'customer:' || c_custkey", "in_nation", "'nation:' || c_nationkey", _file("customers", "c_custkey"), "c_custkey"),
    _sql("supplier", "'supplier:' || s_suppkey", "in_nation", "'nation:' || s_nationkey", _file("suppliers", "s_suppkey"), "s_suppkey"),
    _sql("nation", "'nation:' || n_nationkey", "in_region", "'region:' || n_regionkey", _file("nations", "n_nationkey"), "0"),
    _sql("orders", "'order:' || o_orderkey", "ordered_on", "CAST(CAST(o_orderdate AS DATE) AS VARCHAR)", _file("orders", "o_orderkey"), "o_orderkey"),
    _sql("part", "'part:' || p_partkey", "has_size", "CAST(p_size AS VARCHAR)", _file("parts", "p_partkey"), "p_partkey"),
    _sql("orders", "'order:' || o_orderkey", "has_total", "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)", _file("orders", "o_orderkey"), "(o_orderkey + 1)"),
    _sql("orders", "'customer:' || o_custkey", "has_priority", "o_orderpriority", _file("orders", "o_orderkey"), "o_orderkey"),
    _sql("lineitem", "'part:' || l_partkey", "sold_as", "l_returnflag || l_linestatus", "'sources/supplier_' || l_suppkey || '.md#line' || l_linenumber", "l_orderkey"),
]) + ")"

ENGINE_SQL = FACTS + ",\nengine AS (SELECT * FROM facts WHERE status IN ('confirmed','accepted'))"
IN_ATTRIBUTES = "(" + ",".join(f"'{a}'" for a in ATTRIBUTES) + ")"


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(u, v): supplier's nation to customer's nation over all orders: at most as many nodes as nations, with cycles."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    joined = lines.join(o, lines.l_orderkey == o.o_orderkey).join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select(entity("nation", "s_nationkey").alias("u"), entity("nation", "c_nationkey").alias("v")).distinct()


TRADES = """trades AS (SELECT DISTINCT 'nation:' || s_nationkey AS u, 'nation:' || c_nationkey AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""
