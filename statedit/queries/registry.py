"""Registry of runnable queries with their reference SQL over the same Parquet tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.survey_views import SurveyViews

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# The survey views again, written independently in SQL.
VIEWS = {
    "receipts": """
        SELECT CAST(year(o_orderdate) AS INTEGER) AS period, CAST(o_custkey AS VARCHAR) AS unit,
               o_orderpriority AS form, CAST(o_orderkey AS VARCHAR) AS ref, o_orderdate AS received_at,
               o_orderstatus = 'F' AS edited, o_orderstatus <> 'P' AS active,
               CASE o_orderstatus WHEN 'F' THEN 'Ferdig' WHEN 'O' THEN 'Ubehandlet' ELSE 'Under arbeid' END AS status
        FROM orders""",
    "units": """
        SELECT CAST(y.period AS INTEGER) AS period, CAST(c_custkey AS VARCHAR) AS unit,
               c_mktsegment || ', N-' || CAST(c_nationkey AS VARCHAR) AS form
        FROM customer CROSS JOIN (
            SELECT unnest(range(lo, hi + 1)) AS period
            FROM (SELECT min(year(o_orderdate)) AS lo, max(year(o_orderdate)) AS hi FROM orders)) y""",
    "municipalities": """
        SELECT CAST(c_custkey AS VARCHAR) AS unit,
               lpad(CAST(n_regionkey AS VARCHAR), 2, '0') || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS municipality
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "unit_info": """
        SELECT CAST(c_custkey AS VARCHAR) AS unit, 'name' AS variable, c_name AS value FROM customer
        UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'segment', c_mktsegment FROM customer
        UNION ALL SELECT unit, 'municipality', municipality FROM municipalities""",
    "per_order": """
        SELECT l_orderkey,
               CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS VARCHAR) AS quantity,
               CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS VARCHAR) AS price,
               CAST(count(*) AS VARCHAR) AS lines, max(l_returnflag) AS flag
        FROM lineitem GROUP BY l_orderkey""",
    "observations_wide": """
        SELECT CAST(year(o_orderdate) AS INTEGER) AS period, o_orderpriority AS form,
               CAST(o_custkey AS VARCHAR) AS unit, CAST(o_orderkey AS VARCHAR) AS ref,
               quantity, price, lines, flag
        FROM orders JOIN per_order ON o_orderkey = l_orderkey""",
    "observations": """
        SELECT period, form, unit, ref, 'quantity' AS variable, quantity AS value FROM observations_wide
        UNION ALL SELECT period, form, unit, ref, 'price', price FROM observations_wide
        UNION ALL SELECT period, form, unit, ref, 'lines', lines FROM observations_wide
        UNION ALL SELECT period, form, unit, ref, 'flag', flag FROM observations_wide""",
    "numeric_observations": """
        SELECT period, form, unit, ref, variable, CAST(trunc(TRY_CAST(value AS DOUBLE)) AS BIGINT) AS v
        FROM observations WHERE variable <> 'flag'""",
    "types": """
        SELECT * FROM (VALUES ('quantity', 'int', 1), ('price', 'number', 2), ('lines', 'integer', 3),
                              ('flag', 'string', 4)) t(variable, datatype, rowno)""",
    "ledger": """
        SELECT l_orderkey AS seq, CAST(l_linenumber AS VARCHAR) AS account,
               CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS amount
        FROM lineitem GROUP BY 1, 2
        UNION ALL SELECT o_orderkey, 'total', CAST(o_totalprice AS DECIMAL(38,2)) FROM orders""",
    "chart_ledger": """
        SELECT l_orderkey AS seq, CAST(1000 + (l_partkey * 37) % 8000 AS VARCHAR) AS account,
               CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS amount
        FROM lineitem GROUP BY 1, 2""",
    "update_counts": """
        SELECT l_orderkey AS seq, count(*) AS n_changes FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1""",
    "versions": """
        SELECT CAST(o_custkey AS VARCHAR) AS unit, CAST(year(o_orderdate) AS INTEGER) AS period, o_orderkey AS seq,
               CAST(o_orderkey % 9 + 1 AS INTEGER) AS version_no, o_orderdate AS received_at FROM orders""",
    "counted": """
        SELECT v.*, coalesce(u.n_changes, 0) AS n_changes FROM versions v LEFT JOIN update_counts u USING (seq)""",
    "comments": """
        SELECT event_id AS id, CAST(user_id AS VARCHAR) AS unit,
               CASE WHEN event_type IN ('signup', 'error') THEN 'general' ELSE 'variable' END AS level,
               CASE WHEN event_type NOT IN ('signup', 'error') THEN event_type END AS variable,
               props AS comment, 1 AS version, value > 10 AS active, ts AS created_at,
               'user' || CAST(user_id AS VARCHAR) AS created_by FROM events""",
    "changes": """
        SELECT CAST(user_id AS VARCHAR) AS ref, event_type AS variable, CAST(value AS VARCHAR) AS new_value,
               ts AS changed_at, CASE WHEN event_type = 'signup' THEN 'Altinn3' ELSE 'editering' END AS process_type,
               event_id AS hist_id FROM events""",
    "receipts_q": """
        SELECT period AS year, CAST(quarter(received_at) AS INTEGER) AS quarter, unit, form, ref, received_at, edited, active, status
        FROM receipts""",
    "observations_q": """
        SELECT r.year, r.quarter, o.form, o.unit, o.ref, o.variable, o.value FROM observations o JOIN receipts_q r ON r.ref = o.ref""",
    "latest_q": """
        SELECT * FROM receipts_q WHERE active
        QUALIFY row_number() OVER (PARTITION BY year, quarter, unit ORDER BY received_at DESC, ref DESC) = 1""",
    "latest": """
        SELECT * FROM receipts WHERE active
        QUALIFY row_number() OVER (PARTITION BY unit ORDER BY received_at DESC, ref DESC) = 1""",
    "latest_per_period": """
        SELECT * FROM receipts WHERE active
        QUALIFY row_number() OVER (PARTITION BY period, unit ORDER BY received_at DESC, ref DESC) = 1""",
}

NEEDS = {
    "unit_info": ["municipalities"],
    "observations_wide": ["per_order"],
    "observations": ["observations_wide"],
    "numeric_observations": ["observations"],
    "counted": ["versions", "update_counts"],
    "receipts_q": ["receipts"],
    "observations_q": ["observations", "receipts_q"],
    "latest_q": ["receipts_q"],
    "latest": ["receipts"],
    "latest_per_period": ["receipts"],
}


def over(views: str, body: str) -> str:
    """SQL with the named views, and those they need, as common table expressions."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, []):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for v in views.split():
        add(v)
    ctes = ", ".join(f"{v} AS MATERIALIZED ({VIEWS[v]})" for v in ordered)
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"


def query(sql: str | None = None, views: str = "", name: str | None = None):
    """Register ``function(views) -> DataFrame`` under its name, with SQL if there is any."""
    def register(function: Callable[[SurveyViews], DataFrame]):
        key = name or function.__name__
        QUERIES[key] = lambda spark, path: function(SurveyViews(spark, path))
        if sql is not None:
            SQL[key] = over(views, sql) if views else sql.strip()
        return function

    return register
