"""Blockchain-shaped inputs derived from the driver tables.

Each text runs unchanged in Spark SQL and in DuckDB; ``{name}`` stands for a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

SQL = {
    "btc_tx": """
SELECT 'BTC' AS chain, CAST(l_shipdate AS DATE) AS date,
       l_extendedprice AS value_usd, l_quantity AS value_btc,
       l_extendedprice >= 90000 AS is_whale,
       CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0.0E0 END AS exchange_in_usd,
       CASE WHEN l_returnflag = 'A' THEN l_extendedprice ELSE 0.0E0 END AS exchange_out_usd,
       l_tax * 1000 AS fee_rate, l_tax * 100000 AS fee,
       l_quantity - 1 AS vsize,
       CONCAT('s', CAST(l_suppkey AS VARCHAR(20))) AS from_address,
       CASE WHEN l_linenumber = 7 THEN NULL
            ELSE CONCAT('p', CAST(l_partkey AS VARCHAR(20))) END AS to_address,
       l_partkey % 730 AS spent_output_age_days,
       l_orderkey * 8 + l_linenumber AS tx_id
FROM {lineitem}""",
    "btc_blocks": """
SELECT 'BTC' AS chain, CAST(o_orderdate AS DATE) AS date,
       o_custkey % 7 + 1 AS tx_count, o_totalprice / 1000000 AS total_fees_btc,
       CASE WHEN o_orderpriority = '5-LOW' THEN 0.0E0 ELSE 6.25E0 END AS block_subsidy_btc,
       CAST(o_custkey AS DOUBLE) * 100 AS size
FROM {orders}""",
    "eth_tx": """
SELECT 'ETH' AS chain, CAST(ts AS DATE) AS date,
       CAST(ROUND(value * 100) AS DECIMAL(20,0)) * CAST('100000000000000000' AS DECIMAL(18,0)) AS value,
       value * 1.0E9 AS gas_price,
       CONCAT('u', CAST(user_id AS VARCHAR(20))) AS from_address,
       CASE WHEN event_type = 'signup' THEN NULL
            WHEN event_type = 'purchase' THEN '0x00000000219AB540356cBB839Cbe05303d7705Fa'
            ELSE CONCAT('c', CAST(event_id % 50 AS VARCHAR(20))) END AS to_address,
       CASE WHEN event_type = 'view' THEN '0x' WHEN event_type = 'error' THEN NULL
            ELSE props END AS input
FROM {events}""",
    "eth_blocks": """
SELECT 'ETH' AS chain, CAST(ts AS DATE) AS date, EXTRACT(HOUR FROM ts) AS number,
       AVG(value) * 1.0E9 AS base_fee_per_gas
FROM {events} GROUP BY CAST(ts AS DATE), EXTRACT(HOUR FROM ts)""",
    "prices": """
SELECT 'BTC' AS chain, CAST(l_shipdate AS DATE) AS date, AVG(l_extendedprice) AS close
FROM {lineitem} GROUP BY CAST(l_shipdate AS DATE)
UNION ALL
SELECT 'ETH', CAST(ts AS DATE), AVG(value) * 30 FROM {events} GROUP BY CAST(ts AS DATE)""",
    "raw_scores": """
SELECT 'BTC' AS chain, CAST(l_shipdate AS DATE) AS date,
       CAST(SUM(l_partkey) % 101 AS DOUBLE) AS raw_score
FROM {lineitem} GROUP BY CAST(l_shipdate AS DATE)
UNION ALL
SELECT 'ETH', CAST(ts AS DATE), CAST(SUM(user_id) % 101 AS DOUBLE)
FROM {events} GROUP BY CAST(ts AS DATE)""",
    "predictions": """
SELECT CASE WHEN l.doc_id % 2 = 0 THEN 'BTC' ELSE 'ETH' END AS chain,
       CONCAT('1.0.', CAST(l.doc_id % 5 AS VARCHAR(20))) AS model_version,
       l.doc_id AS id, l.quality AS y, (d.n_chars % 1000) / 1000.0E0 AS p
FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id""",
}

TABLES = {
    "btc_tx": ["lineitem"], "btc_blocks": ["orders"], "eth_tx": ["events"], "eth_blocks": ["events"],
    "prices": ["lineitem", "events"], "raw_scores": ["lineitem", "events"],
    "predictions": ["labels", "documents"],
}


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; its schema is read from the file once, not for every use."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(SQL[name], **{t: table(spark, sf_dir, t) for t in TABLES[name]})


def duck(name: str) -> str:
    """The same input as DuckDB text over the registered views."""
    return SQL[name].format(**{t: t for t in TABLES[name]})
