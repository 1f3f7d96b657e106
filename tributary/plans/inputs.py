"""Sources made of the driver's tables, so that every operator has rows to work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions.places import place
from tributary.sources.schema import CANONICAL

AS_OF = "2024-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_canonical(df: DataFrame, source: str | Column, entity: Column, **columns: Column) -> DataFrame:
    """A canonical record per row with the columns given."""
    columns = {"entity_id": entity, "source": F.lit(source)} | columns

    def one(name: str, kind: str) -> Column:
        value = columns.get(name, F.lit(None)).cast(kind)
        return (F.coalesce(value, F.array().cast(kind)) if kind.startswith("array") else value).alias(name)

    return df.select(*(one(n, k) for n, k in CANONICAL.items()))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical records of customers from three sources that agree, differ and leave gaps."""
    k = F.col("c_custkey")
    customers = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    mail = F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com"))
    ats = as_canonical(
        customers.where("c_custkey % 5 <> 0"),
        "ats",
        k.cast("string"),
        full_name=F.col("c_name"),
        years_of_experience=F.col("c_acctbal") / 1000,
        location=place(city=F.col("n_name"), country_code=F.lit("")),
        emails=F.array(mail, F.concat(F.lit("work."), mail)),
    )
    named = F.concat(F.when(F.expr("c_custkey % 7 = 0"), F.upper("c_name")).otherwise(F.col("c_name")), F.when(F.expr("c_custkey % 11 = 0"), " Jr").otherwise(""))
    csv = as_canonical(
        customers.where("c_custkey % 3 <> 0"),
        "csv",
        k.cast("string"),
        full_name=named,
        years_of_experience=F.when(F.expr("c_custkey % 2 = 0"), F.col("c_acctbal") / 1000),
        location=F.when(F.expr("c_custkey % 4 <> 0"), place(city=F.lit(""), state=F.concat(F.lit("S"), F.expr("c_custkey % 9")), country=F.col("c_mktsegment"))),
        emails=F.array(F.concat(F.lit("work."), mail), F.concat(F.lit("home."), mail)),
    )
    notes = as_canonical(
        table(spark, sf_dir, "documents").where("doc_id is not null"),
        "notes",
        F.col("doc_id").cast("string"),
        full_name=F.concat(F.lit("Customer#"), F.lpad(F.col("doc_id").cast("string"), 9, "0")),
        summary=F.col("lang"),
    )
    return ats.unionByName(csv).unionByName(notes)


#: The same records in SQL: (entity_id, priority, weight, source, full_name, years, city, state, country, code, mails).
PEOPLE = """people AS (
  SELECT c_custkey::VARCHAR AS entity_id, 0 AS priority, 0.95::DOUBLE AS weight, 'ats' AS source, c_name AS full_name, c_acctbal / 1000 AS years, n_name AS city, NULL AS state, NULL AS country, '' AS code,
         [lower(replace(c_name, '#', '.')) || '@example.com', 'work.' || lower(replace(c_name, '#', '.')) || '@example.com'] AS mails, true AS placed
  FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 5 <> 0
  UNION ALL
  SELECT c_custkey::VARCHAR, 1, 0.92::DOUBLE, 'csv', CASE WHEN c_custkey % 7 = 0 THEN upper(c_name) ELSE c_name END || CASE WHEN c_custkey % 11 = 0 THEN ' Jr' ELSE '' END,
         CASE WHEN c_custkey % 2 = 0 THEN c_acctbal / 1000 END, CASE WHEN c_custkey % 4 <> 0 THEN '' END, CASE WHEN c_custkey % 4 <> 0 THEN 'S' || (c_custkey % 9) END, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END, NULL,
         ['work.' || lower(replace(c_name, '#', '.')) || '@example.com', 'home.' || lower(replace(c_name, '#', '.')) || '@example.com'], c_custkey % 4 <> 0
  FROM customer WHERE c_custkey % 3 <> 0
  UNION ALL
  SELECT doc_id::VARCHAR, 4, 0.70::DOUBLE, 'notes', 'Customer#' || lpad(doc_id::VARCHAR, 9, '0'), NULL, NULL, NULL, NULL, NULL, [], false FROM documents WHERE doc_id IS NOT NULL
)"""
