"""The entity view over the star-schema tables, one SQL text for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Every third customer has a dirty twin with another suffix, street form, state form, phone format and zip.
ENTITY_SQL = """
WITH base AS (
  SELECT c_custkey AS k, p_name AS w, n_name AS nn, c_custkey % 200 AS z
  FROM {customer} JOIN {part} ON p_partkey = c_custkey JOIN {nation} ON n_nationkey = c_nationkey),
v AS (SELECT k, 0 AS t, w, nn, z FROM base UNION ALL SELECT k, 1 AS t, w, nn, z FROM base WHERE k % 3 = 0)
SELECT concat(CASE t WHEN 0 THEN 'a' ELSE 'b' END, lpad(CAST(k AS STRING), 8, '0')) AS id,
  concat(upper(substr(w, 1, 1)), substr(w, 2), ' Group ', CAST(k % 97 AS STRING),
         CASE (k + 2 * t) % 5 WHEN 0 THEN ' Inc.' WHEN 1 THEN ' LLC' WHEN 2 THEN ' Corporation' WHEN 3 THEN ' Ltd' ELSE '' END) AS name,
  concat(CAST(100 + k % 900 AS STRING), ' ', CASE k % 4 WHEN 0 THEN 'North ' WHEN 1 THEN '' WHEN 2 THEN 'SE ' ELSE 'the ' END, w,
         CASE (k + t) % 2 WHEN 0 THEN CASE k % 3 WHEN 0 THEN ' Street' WHEN 1 THEN ' Avenue' ELSE ' Parkway' END
                          ELSE CASE k % 3 WHEN 0 THEN ' St' WHEN 1 THEN ' Ave' ELSE ' Pkwy' END END,
         CASE WHEN k % 4 = 0 AND t = 0 THEN concat(' Apt ', CAST(k % 40 AS STRING)) ELSE '' END) AS address,
  replace(nn, 'NATION_', 'City of  ') AS city,
  CASE (k + t) % 6 WHEN 0 THEN 'New York' WHEN 1 THEN 'ny' WHEN 2 THEN 'California' WHEN 3 THEN 'TX' WHEN 4 THEN 'Ontario' ELSE '' END AS state,
  concat(lpad(CAST(z * 397 AS STRING), 5, '0'), CASE WHEN t = 1 THEN '-1234' ELSE '' END) AS zip,
  CASE (k + t) % 4 WHEN 0 THEN concat('(555) 123-', lpad(CAST(k % 10000 AS STRING), 4, '0'))
                   WHEN 1 THEN concat('+1-555-123-', lpad(CAST(k % 10000 AS STRING), 4, '0'))
                   WHEN 2 THEN concat('555.123.', lpad(CAST(k % 10000 AS STRING), 4, '0'))
                   ELSE concat('+1 (555) 123-', lpad(CAST(k % 10000 AS STRING), 4, '0')) END AS phone,
  concat(CASE t WHEN 0 THEN 'info' ELSE 'Contact' END, CAST(k AS STRING), '@', replace(w, ' ', '-'), CASE k % 2 WHEN 0 THEN '.com' ELSE '.COM' END) AS email
FROM v"""

#: Each entity against its dirty twin, and against the next one.
PAIR_SQL = """
SELECT x.id AS id_a, y.id AS id_b, {columns}
FROM {entities} x JOIN {entities} y
  ON y.id = concat('b', substr(x.id, 2)) OR y.id = concat('a', lpad(CAST(CAST(substr(x.id, 2) AS INT) + 1 AS STRING), 8, '0'))
WHERE x.id LIKE 'a%'"""
FIELDS = ("name", "address", "city", "state", "zip", "phone", "email")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return spark.sql(ENTITY_SQL, customer=read("customer"), part=read("part"), nation=read("nation"))


def entity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two equi-joins instead of the OR of the SQL text."""
    from pyspark.sql import functions as F

    e = entities(spark, sf_dir)
    x = e.filter(F.col("id").startswith("a")).select(F.col("id").alias("id_a"), *[F.col(f).alias(f"{f}_a") for f in FIELDS])
    y = e.select(F.col("id").alias("id_b"), *[F.col(f).alias(f"{f}_b") for f in FIELDS])
    number = F.substring("id_a", 2, 8)
    twin = F.concat(F.lit("b"), number)
    after = F.concat(F.lit("a"), F.lpad((number.cast("int") + 1).cast("string"), 8, "0"))
    keyed = x.withColumn("id_b", F.explode(F.array(twin, after)))
    return keyed.join(y, "id_b")
