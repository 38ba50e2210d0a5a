"""The driver's star schema in the roles of a perturbation screen, for Spark and, as named queries, for SQL.

cells are orders (line: nation, chunk: region, control: lowest priority), expression is quantity by brand, predictions and
labels are arithmetic of the orders' keys, latent vectors are the embeddings, time courses are users' events.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

#: name: query over the driver's tables or over earlier names
CTES: dict[str, str] = {
    "cells": """SELECT o_orderkey AS cell_id, n_regionkey AS chunk_id, c_nationkey AS cell_line, o_orderpriority AS pert_id, o_orderpriority = '5-LOW' AS is_control,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'CONTROL' ELSE 'SCAF' || (o_custkey % 30)::VARCHAR END AS scaffold_id,
  CASE WHEN o_orderpriority = '5-LOW' THEN 0.0::DOUBLE ELSE o_totalprice / 1e5::DOUBLE END AS dose_um, (24 * month(o_orderdate))::DOUBLE AS time_h
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "expr": "SELECT l_orderkey AS cell_id, p_brand AS gene, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL",
    "preds": """SELECT o_orderkey AS cell_id, c_nationkey AS fold, o_custkey % 97 AS donor,
  floor(o_totalprice)::BIGINT % 1000 / 250.0::DOUBLE AS z0, o_custkey % 97 / 40.0::DOUBLE AS z1, o_orderkey % 89 / 50.0::DOUBLE AS z2,
  CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS y,
  (o_orderkey % 61 - 35)::DOUBLE AS mu_age, 1 + o_custkey % 7 / 4.0::DOUBLE AS sigma_age, (o_orderkey % 61 - 35 + o_custkey % 13 - 6)::DOUBLE AS y_age,
  o_orderkey % 5 <> 0 AS age_mask, o_orderkey % 11 <> 0 AS in_dist
  FROM orders JOIN customer ON o_custkey = c_custkey""",
    "probs": """SELECT *, exp(z0 - m) / t AS p0, exp(z1 - m) / t AS p1, exp(z2 - m) / t AS p2 FROM (
  SELECT *, exp(z0 - m) + exp(z1 - m) + exp(z2 - m) AS t FROM (SELECT *, greatest(z0, z1, z2) AS m FROM preds))""",
    "course": "SELECT user_id AS donor, event_id AS row_id, (epoch_us(ts) // 86400000000)::BIGINT - 19723 AS day, value, event_type AS pert_id FROM events",
}


def sql(select: str, **more: str) -> str:
    """`select` with the named queries that it needs, in order of definition, before it."""
    names = CTES | more
    wanted: set[str] = set()

    def visit(text: str) -> None:
        for n in names:
            if n not in wanted and re.search(rf"\b{n}\b", text):
                wanted.add(n)
                visit(names[n])

    visit(select)
    parts = ",\n".join(f"{n} AS MATERIALIZED ({q})" for n, q in names.items() if n in wanted)
    return (f"WITH {parts}\n" if parts else "") + select


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    control = F.col("o_orderpriority") == "5-LOW"
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(
        F.col("o_orderkey").alias("cell_id"),
        F.col("n_regionkey").alias("chunk_id"),
        F.col("c_nationkey").alias("cell_line"),
        F.col("o_orderpriority").alias("pert_id"),
        control.alias("is_control"),
        F.when(control, F.lit("CONTROL")).otherwise(F.concat(F.lit("SCAF"), (F.col("o_custkey") % 30).cast("string"))).alias("scaffold_id"),
        F.when(control, F.lit(0.0)).otherwise(F.col("o_totalprice") / 1e5).alias("dose_um"),
        (24.0 * F.month("o_orderdate")).alias("time_h"),
    )


def expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("cell_id"), F.col("p_brand").alias("gene")).agg(F.sum("l_quantity").alias("value"))


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return orders.join(customer, cust == F.col("c_custkey")).select(
        key.alias("cell_id"),
        F.col("c_nationkey").alias("fold"),
        (cust % 97).alias("donor"),
        (F.floor("o_totalprice") % 1000 / 250.0).alias("z0"),
        (cust % 97 / 40.0).alias("z1"),
        (key % 89 / 50.0).alias("z2"),
        F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("y"),
        (key % 61 - 35).cast("double").alias("mu_age"),
        (1 + cust % 7 / 4.0).alias("sigma_age"),
        (key % 61 - 35 + cust % 13 - 6).cast("double").alias("y_age"),
        (key % 5 != 0).alias("age_mask"),
        (key % 11 != 0).alias("in_dist"),
    )


def probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.columns import softmax

    p = softmax(F.col("z0"), F.col("z1"), F.col("z2"))
    return preds(spark, sf_dir).withColumns({"p0": p[0], "p1": p[1], "p2": p[2]})


def course(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("user_id").alias("donor"), F.col("event_id").alias("row_id"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("day"), "value", F.col("event_type").alias("pert_id")
    )


def gene_number(gene: str = "gene") -> F.Column:
    return F.regexp_extract(gene, r"(\d+)$", 1).cast("int")


GENE_NUMBER = r"regexp_extract(gene, '([0-9]+)$', 1)::INT"
