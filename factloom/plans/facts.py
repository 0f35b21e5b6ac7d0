"""Fact tables that Spark derives from the driver's star schema, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.sources.tables import read

EDGES_SQL = """
select c_name as subject, 'LOCATED_IN' as relation, n_name as object, 'crm' as source_name, c_custkey as ordinal
from customer join nation on c_nationkey = n_nationkey
union all select s_name, 'LOCATED_IN', n_name, 'erp', s_suppkey + 1000000000000 from supplier join nation on s_nationkey = n_nationkey
union all select n_name, 'PART_OF', r_name, 'geo', n_nationkey + 2000000000000 from nation join region on n_regionkey = r_regionkey
union all select concat('Part#', p_partkey), 'IS_A', p_type, 'catalog', p_partkey + 3000000000000 from part
union all select concat('Part#', p_partkey), 'MADE_BY', p_brand, 'catalog', p_partkey + 4000000000000 from part
"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    """(subject, relation, object, source_name, ordinal): customers and suppliers in nations, nations in regions, parts' types and brands."""
    nation = read(spark, d, "nation")
    at = lambda key, n: (F.col(key).cast("long") + F.lit(n * 1000000000000)).alias("ordinal")

    def fact(df: DataFrame, subject, relation: str, obj: str, source: str, key: str, n: int) -> DataFrame:
        return df.select(subject.alias("subject"), F.lit(relation).alias("relation"), F.col(obj).alias("object"), F.lit(source).alias("source_name"), at(key, n))

    customer = read(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    supplier = read(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    region = nation.join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    part, name = read(spark, d, "part"), F.concat(F.lit("Part#"), F.col("p_partkey"))
    out = fact(customer, F.col("c_name"), "LOCATED_IN", "n_name", "crm", "c_custkey", 0)
    out = out.unionByName(fact(supplier, F.col("s_name"), "LOCATED_IN", "n_name", "erp", "s_suppkey", 1))
    out = out.unionByName(fact(region, F.col("n_name"), "PART_OF", "r_name", "geo", "n_nationkey", 2))
    out = out.unionByName(fact(part, name, "IS_A", "p_type", "catalog", "p_partkey", 3))
    return out.unionByName(fact(part, name, "MADE_BY", "p_brand", "catalog", "p_partkey", 4))


SHIPS_SQL = """
select concat('Part#', l_partkey) as subject, 'SHIPPED_BY' as relation, concat('Supp#', l_suppkey) as object, 'sales' as source_name, min(l_orderkey) as ordinal
from lineitem group by l_partkey, l_suppkey
"""


def ships(spark: SparkSession, d: str) -> DataFrame:
    """The part-supplier graph: each pair once."""
    pairs = read(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min("l_orderkey").alias("ordinal"))
    return pairs.select(F.concat(F.lit("Part#"), F.col("l_partkey")).alias("subject"), F.lit("SHIPPED_BY").alias("relation"), F.concat(F.lit("Supp#"), F.col("l_suppkey")).alias("object"), F.lit("sales").alias("source_name"), "ordinal")


QUANTITIES_SQL = """
select concat('Part#', l_partkey) as subject, concat('QTY_', l_linestatus) as relation, cast(cast(l_quantity as bigint) as varchar) as object,
l_returnflag as source_name, l_orderkey * 1000000 + l_linenumber * 100000 + l_suppkey as ordinal, l_quantity as number
from lineitem
"""


def quantities(spark: SparkSession, d: str) -> DataFrame:
    """What each return flag, taken as a source, says of a part's quantities."""
    return read(spark, d, "lineitem").select(
        F.concat(F.lit("Part#"), F.col("l_partkey")).alias("subject"),
        F.concat(F.lit("QTY_"), F.col("l_linestatus")).alias("relation"),
        F.col("l_quantity").cast("long").cast("string").alias("object"),
        F.col("l_returnflag").alias("source_name"),
        (F.col("l_orderkey") * 1000000 + F.col("l_linenumber") * 100000 + F.col("l_suppkey")).alias("ordinal"),
        F.col("l_quantity").alias("number"),
    )


def number_value(number: str = "number"):
    """The value struct of a numeric column."""
    return F.struct(F.col("object").alias("normalized_value"), F.lit("u").alias("normalized_unit"), F.col(number).cast("double").alias("numeric_value"))
