"""Filters, latest-per-key, joins, sorts and set operations."""

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import aggregates as A
from ..operators import filters as FL
from ..operators import joins as J
from ..operators import latest as L
from ..operators import quality as Q
from ..scratch import materialize, small_table
from .registry import query

# --- filters ---------------------------------------------------------------------------


@query("SELECT * FROM receipts WHERE period IN (1997, 1998) AND status = 'Ubehandlet'", "receipts")
def filter_by(v):
    return FL.filter_by(v.receipts(), {"period": [1997, 1998], "status": "Ubehandlet"})


@query("SELECT unit, ref, edited, status FROM receipts", "receipts")
def select_matching(v):
    return FL.select_matching(v.receipts(), ["unit", "ref"], "edited|status")


@query("SELECT * FROM observations WHERE variable IN ('quantity', 'price', 'lines')", "observations")
def keep_numeric_variables(v):
    obs = v.observations()
    return FL.keep_numeric_variables(obs, v.types()).select(*obs.columns)


@query("SELECT period, form, unit, ref, variable, CAST(trunc(TRY_CAST(value AS DOUBLE)) AS BIGINT) AS value FROM observations",
       "observations")
def coerce_numeric(v):
    return FL.with_numeric_value(v.observations())


@query("""
    SELECT ref AS id, period AS aar, unit AS ident, ref, '' AS comment FROM receipts""", "receipts", "align_columns")
def align(v):
    raw = v.receipts().select("period", "unit", "ref", F.lit("x").alias("name_right"), "ref")
    raw = FL.drop_if_present(raw.toDF("period", "unit", "ref", "name_right", "id"), ["technical"])
    return FL.align_columns(raw, {"period": "aar", "unit": "ident"}, ["id", "aar", "ident", "ref", "comment"])


@query("""
    SELECT l_orderkey, l_linenumber, 'discount' AS variable, CAST(l_discount AS VARCHAR) AS value
    FROM lineitem WHERE l_discount > 0
    UNION ALL SELECT l_orderkey, l_linenumber, 'tax', CAST(l_tax AS VARCHAR) FROM lineitem WHERE l_tax > 0""")
def unpivot(v):
    lines = v.source("lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax")
    )
    return FL.unpivot(lines, ["l_orderkey", "l_linenumber"], ["discount", "tax"], positive_only=True)


@query("SELECT unit, left(value, 2) AS county FROM unit_info WHERE variable = 'municipality'", "unit_info")
def attribute(v):
    return FL.attribute(v.unit_info(), "municipality", "county", lambda c: F.left(c, F.lit(2)))


@query("""
    SELECT unit, max(value) FILTER (variable = 'name') AS name, max(value) FILTER (variable = 'segment') AS segment
    FROM unit_info GROUP BY unit""", "unit_info")
def attributes(v):
    return FL.attributes(v.unit_info(), ["name", "segment"])


@query("""
    SELECT seq, account, amount FROM chart_ledger JOIN versions USING (seq)
    WHERE account NOT IN ('3001', '3002', '3003', '3004', '3005', '3006', '3007', '3008', '3886')
       OR unit IN (SELECT unit FROM municipalities WHERE left(municipality, 2) = '04')""",
       "chart_ledger versions municipalities")
def exclude_codes(v):
    ledger = v.chart_ledger().join(v.versions().select("seq", "unit"), "seq")
    members = A.regional_attributes(v.unit_info()).where(F.left("municipality", F.lit(2)) == "04")
    out = FL.exclude_codes(ledger, sector_units=members)
    return out.select("seq", "account", F.col("amount").cast("decimal(38,2)").alias("amount"))


@query("""
    SELECT 'unit' AS "check", CASE WHEN unit = '' THEN 'missing' WHEN NOT regexp_full_match(unit, '[0-9]+') THEN 'not_digits'
        WHEN length(unit) <> 9 THEN 'wrong_length' ELSE 'ok' END AS status, count(*) AS n FROM observations GROUP BY 2
    UNION ALL
    SELECT 'period', CASE WHEN period BETWEEN 1996 AND 2000 THEN 'ok' ELSE 'out_of_range' END, count(*) FROM observations GROUP BY 2
    UNION ALL
    SELECT 'value', CASE WHEN regexp_full_match(value, '[+-]?[0-9]+') THEN 'ok' ELSE 'not_an_integer' END, count(*)
    FROM observations GROUP BY 2""", "observations")
def field_report(v):
    return FL.field_report(v.observations(), {
        "unit": C.org_number_status("unit"),
        "period": C.year_status("period", 1996, 2000),
        "value": C.amount_status("value"),
    })


@query("""
    SELECT ref, variable, value,
        CASE WHEN variable = 'lines' THEN 'ok' WHEN variable = 'price' THEN 'float' WHEN variable = 'flag' THEN 'ok'
             ELSE 'int' END AS status
    FROM observations""", "observations")
def datatype_status(v):
    return FL.datatype_report(v.observations(), v.types()).select("ref", "variable", "value", "status")


@query("""
    SELECT doc_id, regexp_replace(coalesce(source, ''), '\\s+', '', 'g') AS source,
           regexp_replace(lang || '  ' || source, '\\s+', '', 'g') AS joined FROM documents""")
def clean_whitespace(v):
    return v.source("documents").select(
        "doc_id", C.clean_whitespace("source").alias("source"),
        C.clean_whitespace(F.concat("lang", F.lit("  "), "source")).alias("joined"),
    )


@query("SELECT event_id, strftime(date_trunc('second', ts) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS local FROM events")
def local_seconds(v):
    return v.source("events").select("event_id", C.local_seconds("ts").alias("local"))


@query("""
    SELECT unit, CASE WHEN cur IS NOT NULL OR prev IS NOT NULL THEN coalesce(cur, 0) - coalesce(prev, 0) END AS diff,
           CASE WHEN prev <> 0 THEN round((CAST(coalesce(cur, 0) AS DOUBLE) - prev) / prev * 100, 4) END AS pdiff
    FROM (SELECT unit, CAST(sum(v) FILTER (period = 1998) AS BIGINT) AS cur, CAST(sum(v) FILTER (period = 1997) AS BIGINT) AS prev
          FROM numeric_observations WHERE variable = 'quantity' GROUP BY unit)""", "numeric_observations")
def period_change(v):
    q = v.observations().where("variable = 'quantity'").withColumn("v", C.coerce_numeric("value"))
    sums = q.groupBy("unit").agg(
        F.sum(F.when(F.col("period") == 1998, F.col("v"))).alias("cur"),
        F.sum(F.when(F.col("period") == 1997, F.col("v"))).alias("prev"),
    )
    return sums.select("unit", C.change("cur", "prev").alias("diff"), F.round(C.percent_change("cur", "prev"), 4).alias("pdiff"))


@query("""
    SELECT ref, format('{:.2f}', CAST(price AS DOUBLE) / CAST(quantity AS DOUBLE) + CAST(lines AS DOUBLE) - 1.0) AS result
    FROM observations_wide""", "observations_wide")
def calculated_field(v):
    result = C.calculated_field(multiply=["price"], divide=["quantity"], add=["lines"], subtract=[1], decimals=2)
    return v.observations_wide().select("ref", result.alias("result"))


@query("""
    WITH m AS (SELECT DISTINCT period, form, 'price' AS variable, '/' || form || '/price' AS path FROM receipts WHERE edited)
    SELECT o.ref, o.variable, coalesce(m.path, o.variable) AS name
    FROM observations o LEFT JOIN m ON o.period = m.period AND o.form = m.form AND o.variable = m.variable""",
       "receipts observations")
def resolve_name(v):
    mapping = v.receipts().where("edited").select(
        "period", "form", F.lit("price").alias("short"), F.concat(F.lit("/"), "form", F.lit("/price")).alias("path")
    )
    return J.resolve_name(v.observations(), mapping, match="short").select("ref", "variable", "name")


# --- latest per key --------------------------------------------------------------------


@query("SELECT * FROM latest", "latest")
def latest_active(v):
    return L.latest_active(v.receipts())


@query("SELECT * FROM latest_per_period", "latest_per_period")
def latest_active_per_period(v):
    return L.latest_active_per_period(v.receipts())


@query("""
    SELECT id, unit, variable, comment FROM comments WHERE active AND level = 'variable'
    QUALIFY row_number() OVER (PARTITION BY unit, variable ORDER BY created_at DESC, id DESC) = 1""", "comments")
def latest_comment(v):
    return L.latest_comment(v.comments(), "variable").select("id", "unit", "variable", "comment")


@query("""
    SELECT id, unit, comment FROM comments WHERE active AND level = 'general'
    QUALIFY row_number() OVER (PARTITION BY unit ORDER BY created_at DESC, id DESC) = 1""", "comments")
def latest_general_comment(v):
    return L.latest_comment(v.comments(), "general").select("id", "unit", "comment")


@query("""
    SELECT seq, unit, period, version_no, received_at, n_changes FROM counted
    QUALIFY row_number() OVER (PARTITION BY unit, period ORDER BY n_changes > 0 DESC, received_at DESC, seq DESC) = 1""",
       "counted")
def active_version(v):
    return L.active_version(v.versions(), v.update_counts())


@query("""
    SELECT unit, seq FROM counted
    QUALIFY row_number() OVER (PARTITION BY unit ORDER BY n_changes > 0 DESC, received_at DESC, seq DESC) = 1""", "counted")
def default_version(v):
    return L.default_version(L.with_update_counts(v.versions(), v.update_counts()), ["unit"]).select("unit", "seq")


@query("""
    SELECT unit, period, seq, 'v' || CAST(version_no AS VARCHAR) || ' – ' || strftime(received_at, '%Y-%m-%d %H:%M')
           || CASE WHEN n_changes > 0 THEN ' (editert)' ELSE '' END AS label FROM counted WHERE period = 1998
    UNION ALL
    SELECT unit, period, seq, CAST(period AS VARCHAR) FROM (
        SELECT * FROM counted WHERE period <> 1998
        QUALIFY row_number() OVER (PARTITION BY unit, period ORDER BY n_changes > 0 DESC, received_at DESC, seq DESC) = 1)""",
       "counted")
def comparable_versions(v):
    counted = L.with_update_counts(v.versions(), v.update_counts())
    return L.comparable_versions(counted, 1998).select("unit", "period", "seq", "label")


@query("""
    SELECT unit, period, seq,
           row_number() OVER (PARTITION BY unit, period ORDER BY received_at DESC, seq DESC) = 1 AS is_latest FROM versions""",
       "versions")
def is_latest_version(v):
    return L.is_latest_version(v.versions()).select("unit", "period", "seq", "is_latest")


@query("SELECT *, count(*) OVER (PARTITION BY unit) > 1 AS hit FROM receipts WHERE period = 1998", "receipts")
def duplicate_submissions(v):
    return L.duplicate_submissions(v.receipts(), {"period": 1998})


# --- joins -----------------------------------------------------------------------------


@query("""
    WITH p AS (SELECT * FROM latest_per_period)
    SELECT a.unit, a.ref AS current, b.ref AS previous
    FROM (SELECT * FROM p WHERE period = 1998) a LEFT JOIN (SELECT * FROM p WHERE period = 1997) b USING (unit)""",
       "latest_per_period")
def link_periods(v):
    return J.link_periods(v.receipts(), {"period": 1998}, {"period": 1997})


@query("""
    SELECT o.period, o.form, o.unit, o.ref, o.status, CAST(m.c_nationkey AS VARCHAR) AS enterprise
    FROM receipts o JOIN customer m ON o.unit = CAST(m.c_custkey AS VARCHAR) WHERE o.active""", "receipts")
def establishments_of(v):
    mapping = v.source("customer").select(
        F.col("c_custkey").cast("string").alias("establishment_id"), F.col("c_nationkey").cast("string").alias("unit")
    )
    return J.establishments_of(v.receipts(), mapping, {"active": True}).select(
        "period", "form", "unit", "ref", "status", "enterprise"
    )


@query("SELECT o.*, t.rowno, t.datatype FROM observations o LEFT JOIN types t USING (variable)", "observations types")
def with_metadata(v):
    return J.with_metadata(v.observations(), v.types())


CHANGE_HITS = """
    hits AS (
        SELECT a.period, a.form, a.unit, a.ref, 'large_change' AS control_id,
               abs((a.x - b.x) / b.x * 100) > 100 AS hit, CAST(trunc((a.x - b.x) / b.x * 100) AS INTEGER) AS value
        FROM (SELECT o.*, CAST(o.value AS DOUBLE) AS x FROM observations o JOIN latest_per_period l USING (ref)
              WHERE variable = 'price') a
        JOIN (SELECT o.*, CAST(o.value AS DOUBLE) AS x FROM observations o JOIN latest_per_period l USING (ref)
              WHERE variable = 'price') b ON a.unit = b.unit AND a.period = b.period + 1
        WHERE a.x > 0 AND b.x > 0)"""


def all_change_hits(v):
    """Large changes of the price in every period against the one before."""
    rows = J.responses_in(v.observations().where("variable = 'price'"), L.latest_active_per_period(v.receipts()))
    rows = rows.withColumn("x", F.col("value").cast("double"))
    prev = rows.select("unit", (F.col("period") + 1).alias("period"), F.col("x").alias("y"))
    percent = F.try_divide(F.col("x") - F.col("y"), F.col("y")) * 100
    return rows.join(prev, ["unit", "period"]).where("x > 0 and y > 0").select(
        "period", "form", "unit", "ref", F.lit("large_change").alias("control_id"),
        (F.abs(percent) > 100).alias("hit"), percent.try_cast("int").alias("value"),
    )


@query(f"""
    WITH {CHANGE_HITS}
    SELECT h.unit, h.ref, h.control_id, h.hit, h.value, r.status FROM hits h JOIN receipts r USING (unit, ref)
    WHERE h.hit AND r.active""", "observations latest_per_period")
def hits_with_status(v):
    return J.hits_with_status(all_change_hits(v), v.receipts(), "large_change")


@query(f"""
    WITH {CHANGE_HITS}
    SELECT period, unit, ref, form AS control_id, hit, value, CASE WHEN form <> '5-LOW' THEN 'Large change in ' || form END AS description
    FROM hits""", "observations latest_per_period")
def describe_hits(v):
    """One control per form, and one form whose control is not in the catalogue."""
    controls = v.receipts().where("form <> '5-LOW'").select(
        F.col("form").alias("control_id"), F.concat(F.lit("Large change in "), "form").alias("description")
    )
    hits = all_change_hits(v).withColumn("control_id", F.col("form"))
    return J.describe_hits(hits, controls).drop("form")


@query("""
    SELECT c.variable AS account, t.text, c.ref, c.new_value, c.hist_id
    FROM changes c LEFT JOIN (SELECT 'click' AS account, 'Clicked' AS text UNION ALL SELECT 'view', 'Viewed'
                              UNION ALL SELECT 'unused', 'Never') t ON c.variable = t.account""", "changes")
def describe_log(v):
    texts = small_table(v.spark, [("click", "Clicked"), ("view", "Viewed"), ("unused", "Never")], "account string, text string")
    log = v.changes().select(F.col("variable").alias("account"), "ref", "new_value", "hist_id")
    return J.describe_log(log, texts)


@query("""
    SELECT coalesce(n.unit, o.unit) AS unit, coalesce(n.form, o.form) AS form,
           CASE WHEN o.unit IS NULL THEN 'new_only' WHEN n.unit IS NULL THEN 'old_only' ELSE 'both' END AS outcome
    FROM (SELECT DISTINCT unit, form FROM receipts WHERE period = 1998) n
    FULL JOIN (SELECT DISTINCT unit, form FROM receipts WHERE period = 1997) o ON n.unit = o.unit AND n.form = o.form""",
       "receipts")
def diff_rows(v):
    pairs = lambda p: v.receipts().where(F.col("period") == p).select("unit", "form").distinct()
    return J.diff_rows(pairs(1998), pairs(1997), ["unit", "form"])


@query("SELECT o.* FROM observations o WHERE ref IN (SELECT ref FROM latest)", "observations latest")
def responses_in(v):
    obs = v.observations()
    return J.responses_in(obs, L.latest_active(v.receipts())).select(*obs.columns)


@query("""
    SELECT r.*, NOT EXISTS (SELECT 1 FROM receipts q WHERE q.unit = r.unit AND q.period = r.period - 1) AS hit
    FROM receipts r""", "receipts")
def new_units(v):
    return J.new_units(v.receipts())


@query("""
    SELECT t.table_name, f.form FROM (VALUES ('quantity'), ('price'), ('lines'), ('flag'), ('staff')) t(table_name)
    CROSS JOIN (SELECT DISTINCT form FROM receipts) f
    WHERE NOT EXISTS (SELECT 1 FROM observations o WHERE o.variable = t.table_name AND o.form = f.form)""",
       "receipts observations")
def uncovered_pairs(v):
    covered = v.observations().select(F.col("variable").alias("table_name"), "form").distinct()
    return J.uncovered_pairs(["quantity", "price", "lines", "flag", "staff"], v.receipts(), covered)


@query("""
    SELECT r.form, p.period FROM (SELECT DISTINCT form FROM receipts) r CROSS JOIN (VALUES (1997), (1998)) p(period)""",
       "receipts")
def expand_scope(v):
    return J.expand_scope(v.receipts().select("form").distinct(), {"period": [1997, 1998]})


@query("""
    SELECT r.ref, r.unit, c.c_name AS name, c.c_mktsegment AS segment
    FROM receipts r LEFT JOIN customer c ON r.unit = CAST(c.c_custkey AS VARCHAR)""", "receipts")
def enrich_with_register(v):
    register = v.source("customer").select(
        F.col("c_custkey").alias("org"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")
    )
    return J.enrich_with_register(v.receipts().select("ref", "unit"), register, "unit", "org")


@query("""
    SELECT l.seq, l.account, l.amount, s.heading, s.section
    FROM chart_ledger l JOIN (VALUES
        ('eiendeler', 'anleggsmidler', 1000, 1399), ('eiendeler', 'omløpsmidler', 1400, 1999),
        ('egenkapital_og_gjeld', 'egenkapital', 2000, 2099), ('egenkapital_og_gjeld', 'langsiktig gjeld', 2100, 2299),
        ('egenkapital_og_gjeld', 'kortsiktig gjeld', 2300, 2999)) s(heading, section, lo, hi)
      ON CAST(l.account AS INTEGER) BETWEEN s.lo AND s.hi""", "chart_ledger")
def assign_section(v):
    return J.assign_section(v.chart_ledger(), A.BALANCE_SECTIONS)


@query("""
    SELECT n_name AS region, c_acctbal AS value, n_regionkey AS part
    FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def region_values(v):
    data = v.source("customer").join(v.source("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("region"), F.col("c_acctbal").alias("value")
    )
    regions = v.source("nation").select(F.col("n_name").alias("region"), F.col("n_regionkey").alias("part"))
    return J.region_values(data, regions)


@query("""
    WITH s AS MATERIALIZED (
        SELECT o.unit, o.variable, max(o.value) FILTER (l.period = 1998) AS value,
               max(o.value) FILTER (l.period = 1997) AS previous_value, max(l.period) AS last
        FROM latest_per_period l JOIN observations o ON o.ref = l.ref WHERE l.period IN (1997, 1998) GROUP BY 1, 2),
    known AS MATERIALIZED (SELECT DISTINCT unit FROM latest_per_period WHERE period = 1998),
    j AS (SELECT s.unit, variable, value, previous_value, TRY_CAST(value AS DOUBLE) AS a, TRY_CAST(previous_value AS DOUBLE) AS b
          FROM s JOIN known ON known.unit = s.unit)
    SELECT unit, variable, value, previous_value,
           round(CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN coalesce(a, 0) - coalesce(b, 0) END, 2) AS diff,
           round((coalesce(a, 0) - b) / nullif(b, 0) * 100, 4) AS pdiff FROM j""", "latest_per_period observations")
def year_change(v):
    out = J.year_change(v.observations(), v.receipts(), 1998)
    return out.withColumn("diff", F.round("diff", 2)).withColumn("pdiff", F.round("pdiff", 4))


# --- sorts and sets --------------------------------------------------------------------


@query("SELECT ref, value FROM (SELECT ref, v AS value FROM numeric_observations WHERE variable = 'price') "
       "ORDER BY value DESC, ref LIMIT 5", "numeric_observations")
def top_k(v):
    prices = FL.with_numeric_value(v.observations().where("variable = 'price'")).select("ref", "value")
    return A.top_k(prices, 5, tie=["ref"])


@query(f"""
    WITH {CHANGE_HITS}, o AS (SELECT *, CASE WHEN value > 0 THEN 'up' ELSE 'down' END AS c FROM hits WHERE hit)
    SELECT c AS control_id, unit, ref, value,
           rank() OVER (PARTITION BY c ORDER BY CASE WHEN c = 'down' THEN value ELSE -value END) AS rank FROM o""",
       "observations latest_per_period")
def rank_hits(v):
    hits, controls = _directed_hits(v)
    return A.rank_hits(hits, controls).select("control_id", "unit", "ref", "value", "rank")


@query(f"""
    WITH {CHANGE_HITS}, o AS (SELECT *, CASE WHEN value > 0 THEN 'up' ELSE 'down' END AS c FROM hits WHERE hit)
    SELECT c AS control_id, unit, ref, value, CAST(row_number() OVER (
               PARTITION BY c ORDER BY CASE WHEN c = 'down' THEN value ELSE -value END, unit, ref) AS INTEGER) AS rank
    FROM o QUALIFY rank <= 20""", "observations latest_per_period")
def top_hits(v):
    hits, controls = _directed_hits(v)
    return A.top_hits(hits, controls, 20).select("control_id", "unit", "ref", "value", "rank")


def _directed_hits(v):
    direction = F.when(F.col("value") > 0, "up").otherwise("down")
    # Hits are a stored table in practice; here they are derived, so store them once.
    hits = materialize(all_change_hits(v).withColumn("control_id", direction))
    controls = hits.select("control_id").distinct().withColumn(
        "sort_order", F.when(F.col("control_id") == "down", "ASC").otherwise("DESC")
    )
    return hits, controls


@query("SELECT form, period, ref FROM receipts", "receipts")
def pin_first(v):
    return A.pin_first(v.receipts().select("form", "period", "ref"), "form", "3-MEDIUM", "form", "ref")


@query("SELECT DISTINCT period, unit, form FROM receipts", "receipts")
def forms_of_unit(v):
    return A.forms_of_unit(v.receipts())


@query("SELECT DISTINCT unit, period FROM versions", "versions")
def available_periods(v):
    return A.available_periods(v.versions())


@query("SELECT DISTINCT trim(f) AS form FROM (SELECT unnest(string_split(form, ',')) AS f FROM units)", "units")
def forms_in_frame(v):
    return A.forms_in_frame(v.units())


@query("SELECT ref, 'a' AS source FROM receipts UNION ALL SELECT ref, 'b' FROM observations", "receipts observations")
def union_results(v):
    return A.union_results([
        v.receipts().select("ref", F.lit("a").alias("source")), v.observations().select("ref", F.lit("b").alias("source"))
    ])


# --- quality ---------------------------------------------------------------------------


@query("""
    SELECT unit, period, form, ref FROM receipts
    QUALIFY count(*) OVER (PARTITION BY unit, period, form) > 1""", "receipts")
def duplicate_keys(v):
    return Q.duplicate_keys(v.receipts().select("unit", "period", "form", "ref"), ["unit", "period", "form"])


@query("""
    SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def orphans(v):
    parents = v.source("orders").select(F.col("o_custkey").alias("c_custkey"))
    return Q.orphans(v.source("customer").select("c_custkey", "c_name"), parents, ["c_custkey"])


@query("""
    SELECT 'receipts' AS child, 'units' AS parent, count(*) AS n FROM receipts r
    WHERE NOT EXISTS (SELECT 1 FROM units u WHERE u.unit = r.unit AND u.period = r.period)
    UNION ALL
    SELECT 'observations', 'receipts', count(*) FROM observations o
    WHERE NOT EXISTS (SELECT 1 FROM receipts r WHERE r.ref = o.ref AND r.unit = o.unit AND r.form = o.form AND r.period = o.period)""",
       "receipts units observations")
def reference_report(v):
    return Q.reference_report({"receipts": v.receipts(), "units": v.units(), "observations": v.observations()})


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def require_unique(v):
    customer = v.source("customer").select("c_custkey", "c_name", "c_acctbal")
    Q.check_column_names(Q.require_columns(customer, ["c_custkey"]))
    return Q.require_unique(customer, ["c_custkey"])
