"""Free queries over the registered tables."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..functions.columns import matches


def free_search(
    spark: SparkSession, sql: str, tables: Mapping[str, DataFrame], partitions: Mapping[str, Any] | None = None,
    args: Mapping[str, Any] | list[Any] | None = None,
) -> DataFrame:
    """Run a user's SQL over ``tables``, each restricted to the chosen partitions it has.

    The tables are seen by this query only, as its common table expressions: views and
    tables of the caller with the same names stay as they are, and nothing is left behind.
    Only queries are allowed; a statement that writes, creates or changes anything raises
    ``ValueError`` before it runs. ``args`` fill named (``:year``) or positional markers.
    The technical ``row_id`` is left out of the result.
    """
    _require_query(spark, sql)
    views = {name: f"__search_{uuid.uuid4().hex}" for name in tables}
    body = sql.strip().rstrip(";")
    own = re.match(r"(?is)(?:\s|--[^\n]*\n|/\*.*?\*/)*with\s+(?!recursive\b)", body)
    named = ", ".join(f"`{name}` AS (SELECT * FROM {view})" for name, view in views.items())
    text = body if not tables else f"WITH {named}, {body[own.end():]}" if own else f"WITH {named} {body}"
    try:
        for name, df in tables.items():
            chosen = {k: v for k, v in (partitions or {}).items() if k in df.columns}
            df.where(matches(chosen)).createOrReplaceTempView(views[name])
        # the plan is resolved here, so it no longer needs the views
        return spark.sql(text, args).drop("row_id")
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)


def _require_query(spark: SparkSession, sql: str) -> None:
    """Raise unless the text is one query: no part of its parsed plan may be a command or a write."""
    jvm = spark._jvm
    plans = jvm.java.lang.Class
    logical = "org.apache.spark.sql.catalyst.plans.logical."
    forbidden = [plans.forName(logical + n) for n in ("Command", "ParsedStatement")]
    waiting = [spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)]
    while waiting:
        plan = waiting.pop()
        if any(c.isInstance(plan) for c in forbidden):
            raise ValueError(f"Only queries are allowed, not {plan.nodeName()}")
        children = plan.children().iterator()
        while children.hasNext():
            waiting.append(children.next())
