"""Several period columns, runs that write back, and the catalogues of controls and rules."""

from pyspark.sql import functions as F

from ..functions.periods import BY_YEAR, Spine
from ..operators import aggregates as A
from ..operators import controls as C
from ..operators import editlog as E
from ..operators import filters as FL
from ..operators import joins as J
from ..operators import quality as Q
from ..operators import rules as R
from ..plans.adhoc import free_search
from ..plans.rule_run import period_hits
from ..plans.write_back import store_comments, store_hits, store_replaced, store_upsert
from ..scratch import scratch_path
from ..sources import tables
from ..sources.versioned import Store
from .editing import COMMENT_KEYS, CONTROL_SQL, RESULT_COLUMNS, RULE_SQL, RULES, SYNC_SQL, _context, _stored_rule_hits
from .registry import query
from .totals import ACTIVE_SQL

# --- year and quarter --------------------------------------------------------------------


def _quarters(v):
    return Spine.of(v.receipts_quarterly(), ["year", "quarter"])


QUARTER_TOTALS = """
    SELECT o.variable, sum(CAST(trunc(TRY_CAST(o.value AS DOUBLE)) AS BIGINT)) FILTER (l.year = {y1} AND l.quarter = {q1}) AS cur,
           sum(CAST(trunc(TRY_CAST(o.value AS DOUBLE)) AS BIGINT)) FILTER (l.year = {y2} AND l.quarter = {q2}) AS prev
    FROM latest_q l JOIN observations_q o ON o.ref = l.ref
    WHERE o.variable <> 'flag' AND ((l.year = {y1} AND l.quarter = {q1}) OR (l.year = {y2} AND l.quarter = {q2})) GROUP BY 1"""

TOTALS_SQL = """
    SELECT variable, CAST(cur AS BIGINT) AS "{a}", CAST(prev AS BIGINT) AS "{b}", CAST(cur - prev AS BIGINT) AS diff,
           round(CAST(coalesce(cur, 0) - coalesce(prev, 0) AS DOUBLE) / coalesce(prev, 1) * 100, 2) AS pdiff FROM ({rows})"""


@query(TOTALS_SQL.format(a="1998-1", b="1997-4", rows=QUARTER_TOTALS.format(y1=1998, q1=1, y2=1997, q2=4)), "latest_q observations_q")
def period_totals_quarterly(v):
    """The first quarter against the one before, over New Year."""
    return A.period_totals(v.observations_quarterly(), v.receipts_quarterly(), v.types(), (1998, 1), spine=_quarters(v))


@query(TOTALS_SQL.format(a="1998-1", b="1997-1", rows=QUARTER_TOTALS.format(y1=1998, q1=1, y2=1997, q2=1)), "latest_q observations_q")
def period_totals_same_quarter(v):
    """The first quarter against that of the year before."""
    return A.period_totals(v.observations_quarterly(), v.receipts_quarterly(), v.types(), (1998, 1), spine=_quarters(v), by=BY_YEAR)


@query("""
    WITH n AS MATERIALIZED (SELECT DISTINCT unit, year * 4 + quarter AS no FROM receipts_q)
    SELECT r.*, n.unit IS NULL AS hit FROM receipts_q r LEFT JOIN n ON n.unit = r.unit AND n.no = r.year * 4 + r.quarter - 1""",
       "receipts_q")
def new_units_quarterly(v):
    receipts = v.receipts_quarterly()
    return J.new_units(receipts, spine=Spine.of(receipts, ["year", "quarter"]))


@query("""
    WITH s AS MATERIALIZED (
        SELECT l.unit, max(CAST(o.value AS DOUBLE)) FILTER (l.year = 1998) AS a, max(CAST(o.value AS DOUBLE)) FILTER (l.year = 1997) AS b,
               max(l.form) FILTER (l.year = 1998) AS form, max(l.ref) FILTER (l.year = 1998) AS ref
        FROM latest_q l JOIN observations_q o ON o.ref = l.ref
        WHERE o.variable = 'price' AND ((l.year = 1998 AND l.quarter = 1) OR (l.year = 1997 AND l.quarter = 4)) GROUP BY 1)
    SELECT 1998 AS year, 1 AS quarter, form, unit, ref, abs((a - b) / b * 100) > 100 AS hit, CAST(trunc((a - b) / b * 100) AS INTEGER) AS value
    FROM s WHERE a > 0 AND b > 0""", "latest_q observations_q")
def large_change_quarterly(v):
    ctx = C.ControlContext(
        {"receipts": v.receipts_quarterly(), "observations": v.observations_quarterly()}, {"year": 1998, "quarter": 1},
        options={"variable": "price"}, spine=_quarters(v),
    )
    return C.large_change(ctx)


@query("""
    WITH s AS MATERIALIZED (
        SELECT o.unit, o.variable, max(o.value) FILTER (l.year = 1998) AS value, max(o.value) FILTER (l.year = 1997) AS previous_value
        FROM latest_q l JOIN observations_q o ON o.ref = l.ref
        WHERE (l.year = 1998 AND l.quarter = 1) OR (l.year = 1997 AND l.quarter = 4) GROUP BY 1, 2),
    known AS MATERIALIZED (SELECT DISTINCT unit FROM latest_q WHERE year = 1998 AND quarter = 1),
    j AS (SELECT s.*, TRY_CAST(value AS DOUBLE) AS a, TRY_CAST(previous_value AS DOUBLE) AS b FROM s JOIN known ON known.unit = s.unit)
    SELECT unit, variable, value, previous_value,
           round(CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN coalesce(a, 0) - coalesce(b, 0) END, 2) AS diff,
           round((coalesce(a, 0) - b) / nullif(b, 0) * 100, 4) AS pdiff FROM j""", "latest_q observations_q")
def year_change_quarterly(v):
    out = J.year_change(v.observations_quarterly(), v.receipts_quarterly(), (1998, 1), _quarters(v))
    return out.withColumn("diff", F.round("diff", 2)).withColumn("pdiff", F.round("pdiff", 4))


@query(f"""
    WITH {RULE_SQL},
    v AS (SELECT c.*, CAST(quarter(received_at) AS INTEGER) AS quarter FROM counted c WHERE period = 1998 AND quarter(received_at) = 2),
    p AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY unit ORDER BY n_changes > 0 DESC, received_at DESC, seq DESC) = 1)
    SELECT f.control_id, f.seq, f.hit, f.value, p.unit, p.period AS year, p.quarter FROM fired f JOIN p USING (seq)""", "ledger counted")
def rules_for_quarter(v):
    versions = v.versions().withColumn("quarter", F.quarter("received_at")).withColumnRenamed("period", "year")
    return period_hits(versions, v.update_counts(), v.ledger(), R.rule_terms(v.spark, RULES), (1998, 2), spine=_quarters(v))


# --- write-back --------------------------------------------------------------------------


def _store(v, name, rows, partition_by):
    """A fresh store with one table."""
    store = Store(v.spark, scratch_path(v.spark, "store"))
    t = store.begin()
    t.create(name, rows, partition_by)
    t.commit("first load")
    return store


@query("""
    SELECT period, unit, form, ref, received_at, CASE WHEN period >= 1998 THEN true ELSE edited END AS edited, active,
           CASE WHEN period >= 1998 THEN 'Ferdig' WHEN period = 1995 AND form = '5-LOW' THEN 'Under arbeid' ELSE status END AS status
    FROM receipts""", "receipts")
def stored_upsert(v):
    """Receipts over three runs: those to 1997 loaded, the later ones added, and one folder's status set."""
    receipts = v.receipts()
    keys, done = ["period", "form", "ref"], [F.lit(True).alias("edited"), F.lit("Ferdig").alias("status")]
    store = _store(v, "receipts", receipts.where("period <= 1997"), ["period", "form"])
    store_upsert(store, "receipts", receipts.where("period >= 1998").withColumns({"edited": done[0], "status": done[1]}), keys, ["edited", "status"])
    low = receipts.where("period = 1995 and form = '5-LOW'").select(*keys, F.lit("Under arbeid").alias("status"))
    store_upsert(store, "receipts", low, keys, ["status"])
    return store.read("receipts")


@query(f"""
    WITH {SYNC_SQL}
    SELECT coalesce(e.period, n.period) AS period, coalesce(e.form, n.form) AS form, coalesce(e.unit, n.unit) AS unit,
           coalesce(e.ref, n.ref) AS ref, coalesce(e.control_id, n.control_id) AS control_id,
           coalesce(n.hit, e.hit) AS hit, coalesce(n.value, e.value) AS value
    FROM existing e FULL JOIN fresh n ON e.ref = n.ref AND e.unit = n.unit AND e.control_id = n.control_id
     AND e.period = n.period""", "receipts observations latest_per_period")
def stored_hits(v):
    """Stored hits of one run after a later run with another limit and other forms, twice."""
    results = C.run_controls(C.find_controls(C), _context(v, 50)).select(*RESULT_COLUMNS)
    store = _store(v, "hits", results.where("form <> '1-URGENT'"), ["period"])
    fresh = results.where("form <> '5-LOW'").withColumn(
        "hit", F.when(F.col("control_id") == "large_change", F.abs("value") > 100).otherwise(F.col("hit"))
    )
    for _ in range(2):  # the second run changes nothing
        store_hits(store, "hits", fresh, ["period"])
    return store.read("hits")


@query(f"""
    WITH {RULE_SQL}, {ACTIVE_SQL},
    old AS (SELECT f.seq, f.control_id, v.unit, v.period FROM fired f JOIN versions v USING (seq))
    SELECT 'hits' AS part, seq, control_id, -1.0::DOUBLE AS value, period, NULL AS description FROM old WHERE period <> 1998
    UNION ALL SELECT 'hits', f.seq, f.control_id, f.value, p.period, NULL FROM fired f JOIN p USING (seq) WHERE p.period = 1998
    UNION ALL SELECT 'catalogue', NULL, control_id, NULL, 1997, 'kept' FROM (VALUES ('header'), ('triple'), ('tail')) t(control_id)
    UNION ALL SELECT * FROM (VALUES ('catalogue', NULL, 'header', NULL, 1998, 'Lines do not add up'),
        ('catalogue', NULL, 'triple', NULL, 1998, 'First line is off'), ('catalogue', NULL, 'tail', NULL, 1998, 'Last line is off'))""",
       "ledger counted versions")
def stored_rule_run(v):
    """Hits and catalogue of a period replaced in one commit; the other periods' folders stay."""
    rules = R.rule_terms(v.spark, RULES)
    fresh = R.rule_catalogue(rules, 1998, "2026-01-01")
    old = R.rule_catalogue(rules, 1997, "2025-01-01").withColumn("description", F.lit("kept"))
    store = _store(v, "hits", _stored_rule_hits(v), ["period"])
    t = store.begin()
    t.create("catalogue", old.union(fresh.withColumn("description", F.lit("old text"))), ["period"])
    t.commit("catalogue")
    scope = fresh.select("period", "control_id")
    hits = period_hits(v.versions(), v.update_counts(), v.ledger(), rules, 1998)
    store_replaced(store, {"hits": (hits, scope), "catalogue": (fresh, scope)}, "rules of 1998")
    rows = store.read("hits").select(F.lit("hits").alias("part"), "seq", "control_id", "value", "period", F.lit(None).cast("string").alias("description"))
    none = F.lit(None)
    return rows.union(store.read("catalogue").select(
        F.lit("catalogue"), none.cast("bigint"), "control_id", none.cast("double"), "period", "description"))


@query(f"""
    WITH keys AS (SELECT DISTINCT {COMMENT_KEYS} AS k FROM comments WHERE active AND created_at >= TIMESTAMP '2024-01-29')
    SELECT id, unit, level, variable, active AND {COMMENT_KEYS} NOT IN (SELECT k FROM keys) AS active FROM comments
    UNION ALL SELECT DISTINCT i, unit, level, variable, i = -2 FROM comments CROSS JOIN (VALUES (-1), (-2)) t(i)
    WHERE active AND created_at >= TIMESTAMP '2024-01-29'""", "comments")
def stored_comments(v):
    """Two rounds of new comments on every key that was commented on in the last days."""
    comments = v.comments()
    store = _store(v, "comments", comments, ["level"])
    recent = comments.where("active and created_at >= timestamp_ntz'2024-01-29'").select("unit", "level", "variable").distinct()
    for i in (-1, -2):
        new = recent.select(
            F.lit(i).cast("bigint").alias("id"), "unit", "level", "variable", F.lit("checked").alias("comment"),
            F.lit("2024-03-01 00:00:00").cast("timestamp_ntz").alias("created_at"), F.lit("me").alias("created_by"),
        )
        store_comments(store, "comments", new)
    return store.read("comments").select("id", "unit", "level", "variable", "active")


# --- catalogues, rule map, states of a response ----------------------------------------------


@query("""
    SELECT form, c.control_id, c.description, CASE WHEN c.control_id = 'new_unit' THEN 'kept' END AS note
    FROM (SELECT DISTINCT form FROM receipts) f
    CROSS JOIN (VALUES ('new_unit', 'Unit is new this period'), ('large_change', 'Large change from the period before'),
                       ('duplicate_submission', 'Unit has sent more than one response')) c(control_id, description)""", "receipts")
def changed_catalogue(v):
    """A stored control with an old text gets the new one, and no second row."""
    forms = [r[0] for r in v.receipts().select("form").distinct().collect()]
    columns = ["form", "control_id", "kind", "description", "sort_by", "sort_order"]
    meta = {**C.new_unit.control_meta, "description": "an old text"}
    existing = v.receipts().select("form").distinct().select(
        "form", *[F.lit(meta[c]).alias(c) for c in columns[1:]], F.lit("kept").alias("note"))
    return C.register_controls(existing, C.find_controls(C), {"form": forms}).select("form", "control_id", "description", "note")


@query("""
    SELECT CAST(p.period AS INTEGER) AS period, theme, control_id, category, description, 'value' AS sort_by, 'DESC' AS sort_order, '2026-01-01 00:00:00' AS last_run
    FROM (SELECT max(period) AS period FROM versions) p
    CROSS JOIN (VALUES ('income', 'header', 'H', 'Lines do not add up'), ('income', 'triple', 'S', 'First line is off'),
                       ('balance', 'tail', 'S', 'Last line is off')) t(theme, control_id, category, description)""", "versions")
def rule_catalogue(v):
    newest = v.versions().agg(F.max("period")).first()[0]
    out = R.rule_catalogue(R.rule_terms(v.spark, RULES), newest, "2026-01-01")
    return out.withColumn("last_run", F.date_format("last_run", "yyyy-MM-dd HH:mm:ss"))


@query("""
    WITH uses AS (SELECT 'header' AS control_id, unnest(['total','1','2','3','4','5','6','7']) AS account
                  UNION ALL SELECT 'triple', unnest(['1','2','3']) UNION ALL SELECT 'tail', unnest(['7','6','5','4']))
    SELECT DISTINCT control_id FROM uses
    WHERE account IN (SELECT DISTINCT CAST(l_linenumber AS VARCHAR) FROM lineitem WHERE l_discount = 0.1 AND l_linenumber <= 3)""")
def rules_touching(v):
    """Rules that name an account with the highest discount."""
    lines = v.source("lineitem").where("l_discount = 0.1 and l_linenumber <= 3").select("l_linenumber").distinct().collect()
    return R.rules_touching(R.rule_terms(v.spark, RULES), [str(r[0]) for r in lines])


@query("""
    SELECT period, unit, form, ref, received_at, edited, CASE WHEN status = 'Under arbeid' THEN false ELSE active END AS active,
           CASE WHEN status = 'Under arbeid' THEN 'Ferdig' ELSE status END AS status,
           CASE WHEN status = 'Under arbeid' THEN 'closed' WHEN edited THEN 'seen' ELSE '' END AS comment FROM receipts""", "receipts")
def set_receipt_fields(v):
    """Open responses are closed with a comment; edited ones only get a comment."""
    receipts = v.receipts().withColumn("comment", F.lit(""))
    opened = F.col("status") == "Under arbeid"
    updates = receipts.where(opened | F.col("edited")).select(
        "ref", F.when(opened, F.lit(False)).alias("active"), F.when(opened, F.lit("Ferdig")).alias("status"),
        F.when(opened, "closed").otherwise("seen").alias("comment"),
    )
    return E.set_receipt_fields(receipts, updates).select(
        "period", "unit", "form", "ref", "received_at", "edited", "active", "status", "comment")


@query("""
    WITH s AS (
        SELECT ref, variable, value, CASE WHEN period BETWEEN 1996 AND 2000 THEN 'ok' ELSE 'out_of_range' END AS period_status,
               CASE WHEN regexp_full_match(value, '[+-]?[0-9]+') THEN 'ok' ELSE 'not_an_integer' END AS value_status FROM observations)
    SELECT * FROM s WHERE period_status <> 'ok' OR value_status <> 'ok'""", "observations")
def failing_rows(v):
    from ..functions import columns as X

    checks = {"period_status": X.year_status("period", 1996, 2000), "value_status": X.amount_status("value")}
    return FL.failing_rows(v.observations(), checks).select("ref", "variable", "value", *checks)


# --- sections, partitions and references as data ----------------------------------------------


@query("""
    WITH s AS MATERIALIZED (
        SELECT 'h' || CAST(p_size AS VARCHAR) AS heading, CAST(p_partkey AS VARCHAR) AS section, 1000 + 4 * p_partkey AS lo, 1000 + 4 * p_partkey + p_size % 4 AS hi
        FROM part)
    SELECT seq, account, amount, heading, section FROM chart_ledger JOIN s ON CAST(account AS INTEGER) BETWEEN lo AND hi""", "chart_ledger")
def assign_section_by_table(v):
    """Every part is a section of one to four accounts."""
    start = F.lit(1000) + F.col("p_partkey") * 4
    sections = v.source("part").select(
        F.concat(F.lit("h"), F.col("p_size").cast("string")).alias("heading"), F.col("p_partkey").cast("string").alias("section"),
        start.alias("start"), (start + F.col("p_size") % 4).alias("end"))
    out = J.assign_section_by_table(v.chart_ledger(), sections)
    return out.withColumn("amount", F.col("amount").cast("decimal(38,2)"))


@query("""
    WITH busy AS (SELECT period, form FROM receipts GROUP BY 1, 2 QUALIFY row_number() OVER (ORDER BY count(*) DESC, period, form) <= 5)
    SELECT r.period, r.form, r.unit, r.ref, r.active FROM receipts r JOIN busy USING (period, form)""", "receipts")
def scan_chosen(v):
    """The five folders with most responses, found by a query."""
    path = scratch_path(v.spark, "receipts")
    receipts = v.receipts().select("period", "form", "unit", "ref", "active")
    receipts.hint("rebalance", "period", "form").write.partitionBy("period", "form").parquet(path)
    busy = receipts.groupBy("period", "form").count().orderBy(F.desc("count"), "period", "form").limit(5)
    return tables.scan_chosen(v.spark, path, busy.select("period", "form")).select("period", "form", "unit", "ref", "active")


@query("""
    SELECT r.* FROM receipts r WHERE NOT EXISTS (
        SELECT 1 FROM customer c WHERE CAST(c.c_custkey AS VARCHAR) = r.unit AND c.c_mktsegment <> 'BUILDING')""", "receipts")
def orphans_of_a_segment(v):
    """Responses of units that a frame without one segment does not have."""
    frame = v.source("customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").cast("string").alias("unit"))
    return Q.orphans(v.receipts(), frame, ["unit"])


@query("""
    WITH u AS MATERIALIZED (SELECT period, unit FROM units WHERE split_part(form, ',', 1) <> 'BUILDING'),
    r AS MATERIALIZED (SELECT period, form, unit, ref FROM receipts WHERE active)
    SELECT 'receipts' AS child, 'units' AS parent, (SELECT count(*) FROM r WHERE (period, unit) NOT IN (SELECT period, unit FROM u)) AS n
    UNION ALL SELECT 'observations', 'receipts', (SELECT count(*) FROM observations o WHERE (period, form, unit, ref) NOT IN (SELECT period, form, unit, ref FROM r))""",
       "units receipts observations")
def reference_report_orphans(v):
    """Two broken references: units without a segment, and only active responses."""
    return Q.reference_report({
        "units": v.units().where("split_part(form, ',', 1) <> 'BUILDING'"), "receipts": v.receipts().where("active"), "observations": v.observations()})


@query("SELECT unit, count(*) AS n FROM receipts WHERE period = 1997 AND active GROUP BY unit HAVING count(*) >= 2", "receipts")
def free_search_args(v):
    return free_search(
        v.spark, "WITH a AS (SELECT * FROM receipts WHERE active) SELECT unit, count(*) AS n FROM a GROUP BY unit HAVING count(*) >= :least",
        {"receipts": v.receipts()}, {"period": [1997]}, {"least": 2})
