"""The register of queries, and SQL fragments that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

EST = """est AS (SELECT o_orderkey AS estimate_id, c_mktsegment AS owner,
    CASE WHEN regexp_full_match(regexp_replace(lower(trim(o_orderpriority)), '\\s+', '-', 'g'), '[a-z0-9]+(-[a-z0-9]+)*')
         THEN regexp_replace(lower(trim(o_orderpriority)), '\\s+', '-', 'g') ELSE 'unclassified' END AS work_class,
    o_totalprice AS estimated FROM orders JOIN customer ON o_custkey = c_custkey)"""
OUT = """lines AS (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) * (1 + CAST(l_tax AS DECIMAL(4,2)))) AS DOUBLE) AS actual FROM lineitem GROUP BY 1),
    outc AS (SELECT o_orderkey AS estimate_id, actual FROM orders LEFT JOIN lines ON l_orderkey = o_orderkey)"""
HIST = """hist AS (SELECT estimate_id, owner, work_class, estimated, actual, CASE WHEN actual > 0 AND estimated > 0 THEN actual / estimated END AS ratio
    FROM est JOIN outc USING (estimate_id))"""
FACT = """agg AS (SELECT owner, work_class, count(*) AS considered, count(actual) AS resolved, count(ratio) AS n, avg(ln(ratio)) AS mean,
    coalesce(stddev_samp(ln(ratio)), 0) AS sd FROM hist GROUP BY 1, 2),
    ver AS (SELECT *, CASE WHEN work_class = 'unclassified' THEN 'unclassified' WHEN resolved = 0 THEN 'no_resolved_outcomes'
        WHEN n < 5 THEN 'insufficient_sample' ELSE 'measured' END AS verdict FROM agg),
    fac AS (SELECT owner, work_class, considered, resolved, n, resolved - n AS excluded, verdict,
        CASE WHEN verdict = 'measured' THEN round_even(exp(mean), 4) END AS factor, CASE WHEN verdict = 'measured' THEN round_even(sd, 4) END AS spread,
        CASE WHEN verdict = 'measured' THEN round_even(exp(mean) / exp(sd), 4) END AS low, CASE WHEN verdict = 'measured' THEN round_even(exp(mean) * exp(sd), 4) END AS high,
        CASE WHEN verdict = 'measured' THEN round_even(n / (n + 5.0::DOUBLE) / (1 + sd), 4) END AS confidence FROM ver),
    facs AS (SELECT *, CASE WHEN factor > 1.05 THEN 'under' WHEN factor < 0.95 THEN 'over' WHEN factor IS NOT NULL THEN 'none' END AS direction,
        CASE WHEN factor >= 1 THEN factor ELSE round_even(1 / factor, 4) END AS magnitude FROM fac)"""
FINE = EST.replace("c_mktsegment AS owner", "CAST(o_custkey AS VARCHAR) AS owner").replace("FROM orders JOIN customer ON o_custkey = c_custkey", "FROM orders")
VER = """v AS (SELECT user_id AS id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS version,
    event_type = 'error' AS retracted, event_id, value AS payload FROM events)"""
HEAD = f"{VER}, h AS (SELECT id, max(version) AS version FROM v GROUP BY id), head AS (SELECT v.* FROM v JOIN h USING (id, version))"
TR = """t AS (SELECT event_id AS seq, event_type AS agent, user_id AS run_id, CAST(value AS DECIMAL(18,4)) AS cost,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens, ts FROM events)"""
LINK = """link AS (SELECT 'O-' || o_orderkey AS src, 'C-' || o_custkey AS dst, 'assumes' AS link_type FROM orders
    UNION ALL SELECT 'C-' || c_custkey, 'N-' || c_nationkey, 'justified_by' FROM customer
    UNION ALL SELECT 'S-' || s_suppkey, 'N-' || s_nationkey, 'justified_by' FROM supplier
    UNION ALL SELECT 'N-' || n_nationkey, 'R-' || n_regionkey, 'estimated_as' FROM nation)"""


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add
