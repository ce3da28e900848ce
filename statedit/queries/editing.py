"""Controls, sum rules, edits, comments, sources and sinks, free SQL and streams."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import comments as CM
from ..operators import controls as C
from ..operators import editlog as E
from ..operators import filters as FL
from ..operators import rules as R
from ..operators import upsert as U
from ..operators.latest import latest_active_per_period
from ..plans.adhoc import free_search as search
from ..plans.control_run import run_control_suite
from ..plans.period_report import period_report
from ..plans.rule_run import period_hits, run_rules_for_changes, run_rules_for_period, run_rules_for_submission
from ..scratch import scratch_path
from ..sources import logs, tables
from ..streaming.receipts import (
    current_daily_receipts, current_latest_active, read_daily_receipts, start_daily_receipts, stream_daily_receipts,
    stream_latest_active,
)
from .registry import query
from .totals import ACTIVE_SQL

# --- controls --------------------------------------------------------------------------

CONTROL_SQL = """
    scoped AS (SELECT * FROM receipts WHERE period = 1998),
    change AS (
        SELECT a.period, a.form, a.unit, a.ref, (a.x - b.x) / b.x * 100 AS pct
        FROM (SELECT o.*, CAST(o.value AS DOUBLE) AS x FROM observations o JOIN latest_per_period l USING (ref)
              WHERE o.variable = 'price' AND o.period = 1998) a
        JOIN (SELECT o.unit, CAST(o.value AS DOUBLE) AS x FROM observations o JOIN latest_per_period l USING (ref)
              WHERE o.variable = 'price' AND o.period = 1997) b USING (unit) WHERE a.x > 0 AND b.x > 0),
    results AS (
        SELECT period, form, unit, ref, 'duplicate_submission' AS control_id, count(*) OVER (PARTITION BY unit) > 1 AS hit,
               0 AS value FROM scoped
        UNION ALL
        SELECT period, form, unit, ref, 'large_change', abs(pct) > {limit}, CAST(trunc(pct) AS INTEGER) FROM change
        UNION ALL
        SELECT s.period, s.form, s.unit, s.ref, 'new_unit',
               NOT EXISTS (SELECT 1 FROM receipts q WHERE q.unit = s.unit AND q.period = s.period - 1), 0 FROM scoped s)"""

RESULT_COLUMNS = ("period", "form", "unit", "ref", "control_id", "hit", "value")


def _context(v, limit=100):
    return C.ControlContext(
        {"receipts": v.receipts(), "observations": v.observations()}, {"period": 1998},
        options={"variable": "price", "limit": limit},
    )


@query(f"WITH {CONTROL_SQL.format(limit=100)} SELECT * FROM results", "receipts observations latest_per_period")
def run_controls(v):
    return C.run_controls(C.find_controls(C), _context(v)).select(*RESULT_COLUMNS)


@query("""
    SELECT period, unit, ref, form, 'large_change' AS control_id, true AS hit FROM latest_per_period WHERE period = 1998""",
       "latest_per_period")
def validate_result(v):
    rows = latest_active_per_period(v.receipts(), filters={"period": 1998}).select(
        "period", "unit", "ref", "form", F.lit(True).alias("hit")
    )
    return C.validate_result(rows, C.large_change.control_meta, {"period": 1998})


@query("""
    SELECT form, c.control_id, c.kind, c.description, c.sort_by, c.sort_order FROM (SELECT DISTINCT form FROM receipts) f
    CROSS JOIN (VALUES ('new_unit', 'I', 'Unit is new this period', '', 'ASC'),
                       ('large_change', 'S', 'Large change from the period before', '', 'DESC'),
                       ('duplicate_submission', 'I', 'Unit has sent more than one response', '', 'ASC'))
               c(control_id, kind, description, sort_by, sort_order)""", "receipts")
def register_controls(v):
    """Catalogue for all forms: the new-unit control is stored already, the others are added."""
    forms = [r[0] for r in v.receipts().select("form").distinct().collect()]
    columns = ["form", "control_id", "kind", "description", "sort_by", "sort_order"]
    meta = C.new_unit.control_meta
    existing = v.receipts().select("form").distinct().select("form", *[F.lit(meta[c]).alias(c) for c in columns[1:]])
    return C.register_controls(existing, C.find_controls(C), {"form": forms}).select(*columns)


SYNC_SQL = f"""
    {CONTROL_SQL.format(limit=50)},
    existing AS (SELECT * FROM results WHERE form <> '1-URGENT'),
    fresh AS (SELECT r.* REPLACE (CASE WHEN control_id = 'large_change' THEN abs(value) > 100 ELSE hit END AS hit)
              FROM results r WHERE form <> '5-LOW')"""


@query(f"""
    WITH {SYNC_SQL}
    SELECT coalesce(e.period, n.period) AS period, coalesce(e.form, n.form) AS form, coalesce(e.unit, n.unit) AS unit,
           coalesce(e.ref, n.ref) AS ref, coalesce(e.control_id, n.control_id) AS control_id,
           coalesce(n.hit, e.hit) AS hit, coalesce(n.value, e.value) AS value,
           CASE WHEN e.ref IS NULL THEN 'insert' WHEN n.ref IS NULL THEN 'untouched'
                WHEN e.hit = n.hit THEN 'keep' ELSE 'update' END AS outcome
    FROM existing e FULL JOIN fresh n ON e.ref = n.ref AND e.unit = n.unit AND e.control_id = n.control_id
     AND e.period = n.period""", "receipts observations latest_per_period")
def sync_hits(v):
    """Stored hits of one run against a later run with another limit and other forms."""
    results = C.run_controls(C.find_controls(C), _context(v, 50)).select(*RESULT_COLUMNS)
    existing = results.where("form <> '1-URGENT'")
    fresh = results.where("form <> '5-LOW'").withColumn(
        "hit", F.when(F.col("control_id") == "large_change", F.abs("value") > 100).otherwise(F.col("hit"))
    )
    return C.sync_hits(existing, fresh, ["period"])


@query(f"""
    WITH {CONTROL_SQL.format(limit=100)},
    h AS (SELECT period, ref, unit, control_id, hit FROM results
          UNION ALL SELECT period, ref, unit, 'new_unit', true FROM receipts WHERE period <> 1998),
    c AS (SELECT DISTINCT period, control_id FROM h)
    SELECT c.period, c.control_id, count(*) FILTER (h.hit) AS n_hits,
           count(*) FILTER (h.hit AND r.active AND r.status = 'Ubehandlet') AS n_untreated
    FROM c LEFT JOIN h USING (period, control_id) LEFT JOIN receipts r ON r.ref = h.ref AND r.unit = h.unit
    GROUP BY 1, 2""", "receipts observations latest_per_period")
def control_run_overview(v):
    """Register, run, check and sync against stored controls and hits of the other years, then the overview."""
    meta = C.new_unit.control_meta
    others = v.receipts().where("period <> 1998")
    catalogue = others.select("period").distinct().select(
        "period", *[F.lit(meta[c]).alias(c) for c in ("control_id", "kind", "description", "sort_by", "sort_order")]
    )
    hits = others.select(
        "period", "form", "unit", "ref", F.lit("new_unit").alias("control_id"), F.lit(True).alias("hit"), F.lit(0).alias("value")
    )
    run = run_control_suite(C.find_controls(C), _context(v), catalogue, hits)
    return run.overview(v.receipts()).select("period", "control_id", "n_hits", "n_untreated")


# --- sum rules -------------------------------------------------------------------------

RULES = (
    R.SumRule("header", "income", "total", tuple((str(i), 1) for i in range(1, 8)), 1000, "H", "Lines do not add up"),
    R.SumRule("triple", "income", "1", (("2", 1), ("3", -1)), 5000, "S", "First line is off"),
    R.SumRule("tail", "balance", "7", (("6", 1), ("5", 1), ("4", -1)), 1000, "S", "Last line is off"),
)

RULE_SQL = """
    wide AS (SELECT seq, coalesce(sum(amount) FILTER (account = 'total'), 0) AS t,
                    coalesce(sum(amount) FILTER (account <> 'total'), 0) AS lines,
                    coalesce(sum(amount) FILTER (account = '1'), 0) AS a1, coalesce(sum(amount) FILTER (account = '2'), 0) AS a2,
                    coalesce(sum(amount) FILTER (account = '3'), 0) AS a3, coalesce(sum(amount) FILTER (account = '4'), 0) AS a4,
                    coalesce(sum(amount) FILTER (account = '5'), 0) AS a5, coalesce(sum(amount) FILTER (account = '6'), 0) AS a6,
                    coalesce(sum(amount) FILTER (account = '7'), 0) AS a7 FROM ledger GROUP BY seq),
    evaluated AS (
        SELECT 'header' AS control_id, seq, t - lines AS value, 1000 AS threshold FROM wide
        UNION ALL SELECT 'triple', seq, a1 - (a2 - a3), 5000 FROM wide
        UNION ALL SELECT 'tail', seq, a7 - (a6 + a5 - a4), 1000 FROM wide),
    fired AS (SELECT control_id, seq, true AS hit, CAST(value AS DOUBLE) AS value FROM evaluated WHERE abs(value) > threshold)"""


@query(f"WITH {RULE_SQL} SELECT * FROM fired", "ledger")
def evaluate_sum_rules(v):
    return R.evaluate_sum_rules(v.ledger(), R.rule_terms(v.spark, RULES))


@query(f"""
    WITH {RULE_SQL}, {ACTIVE_SQL}
    SELECT f.seq, f.control_id, f.hit, f.value, p.unit, p.period, c.c_mktsegment AS segment
    FROM fired f JOIN p USING (seq) LEFT JOIN customer c ON CAST(c.c_custkey AS VARCHAR) = p.unit
    WHERE p.period = 1998""", "ledger counted")
def rules_for_period(v):
    register = v.source("customer").select(F.col("c_custkey").alias("unit"), F.col("c_mktsegment").alias("segment"))
    return period_hits(v.versions(), v.update_counts(), v.ledger(), R.rule_terms(v.spark, RULES), 1998, register)


def _stored_rule_hits(v):
    """Every version's hits, as left by earlier runs, with a value that a new run replaces."""
    hits = R.evaluate_sum_rules(v.ledger(), R.rule_terms(v.spark, RULES))
    return hits.join(v.versions().select("seq", "unit", "period"), "seq").withColumn("value", F.lit(-1.0))


@query(f"""
    WITH {RULE_SQL}, {ACTIVE_SQL},
    old AS (SELECT f.seq, f.control_id, v.unit, v.period FROM fired f JOIN versions v USING (seq))
    SELECT seq, control_id, true AS hit, -1.0::DOUBLE AS value, unit, period FROM old WHERE period <> 1998
    UNION ALL
    SELECT f.seq, f.control_id, f.hit, f.value, p.unit, p.period FROM fired f JOIN p USING (seq) WHERE p.period = 1998""",
       "ledger counted versions")
def replace_period_hits(v):
    catalogue = v.receipts().where("false").select("period").select(
        "period", *[F.lit("").alias(c) for c in ("control_id", "theme", "category", "description")]
    )
    run = run_rules_for_period(
        _stored_rule_hits(v), catalogue, v.versions(), v.update_counts(), v.ledger(),
        R.rule_terms(v.spark, RULES), 1998, "2026-01-01",
    )
    return run.hits


@query(f"""
    WITH {RULE_SQL}, m AS (SELECT max(seq) AS seq FROM versions)
    SELECT f.seq, f.control_id, f.hit, CASE WHEN f.seq = m.seq THEN f.value ELSE -1.0 END AS value, v.unit, v.period
    FROM fired f JOIN versions v USING (seq), m""", "ledger versions")
def replace_submission_hits(v):
    newest = v.versions().agg(F.max("seq")).first()[0]
    return run_rules_for_submission(
        _stored_rule_hits(v), v.versions(), v.ledger(), R.rule_terms(v.spark, RULES), newest
    ).hits


CHANGED_SQL = """
    changed AS (SELECT DISTINCT l_orderkey AS seq, CAST(l_linenumber AS VARCHAR) AS account FROM lineitem WHERE l_returnflag = 'R'),
    uses AS (SELECT 'header' AS control_id, unnest(['total','1','2','3','4','5','6','7']) AS account
             UNION ALL SELECT 'triple', unnest(['1','2','3']) UNION ALL SELECT 'tail', unnest(['7','6','5','4'])),
    touched AS (SELECT DISTINCT seq, control_id FROM changed JOIN uses USING (account))"""


def _changed(v):
    return v.source("lineitem").where("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("seq"), F.col("l_linenumber").cast("string").alias("account")
    )


@query(f"WITH {CHANGED_SQL} SELECT * FROM touched")
def touched_scope(v):
    return R.touched_scope(R.rule_terms(v.spark, RULES), _changed(v))


@query(f"""
    WITH {RULE_SQL}, {CHANGED_SQL}
    SELECT f.seq, f.control_id, f.hit, CASE WHEN t.seq IS NULL THEN -1.0 ELSE f.value END AS value, v.unit, v.period
    FROM fired f JOIN versions v USING (seq) LEFT JOIN touched t ON t.seq = f.seq AND t.control_id = f.control_id""",
       "ledger versions")
def replace_changed_hits(v):
    return run_rules_for_changes(
        _stored_rule_hits(v), v.versions(), v.ledger(), R.rule_terms(v.spark, RULES), _changed(v)
    ).hits


@query(f"""
    WITH {RULE_SQL}
    SELECT f.seq, f.control_id, f.hit, f.value, v.unit, v.period FROM fired f JOIN versions v USING (seq)
    WHERE control_id = 'header' AND period = 1998""", "ledger versions")
def rule_hits(v):
    hits = R.evaluate_sum_rules(v.ledger(), R.rule_terms(v.spark, RULES)).join(v.versions().select("seq", "unit", "period"), "seq")
    return R.rule_hits(hits, period=1998, control_id="header")


# --- insert, upsert, replace -----------------------------------------------------------


@query("""
    SELECT s_suppkey AS id, s_name AS name FROM supplier
    UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)""")
def insert_new(v):
    suppliers = v.source("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    customers = v.source("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return U.insert_new(suppliers, customers, ["id"])


@query("""
    WITH u AS (SELECT l_orderkey AS seq, CASE WHEN l_returnflag = 'R' THEN CAST(l_linenumber AS VARCHAR) ELSE 'new' END AS account,
                      CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS amount FROM lineitem GROUP BY 1, 2)
    SELECT coalesce(l.seq, u.seq) AS seq, coalesce(l.account, u.account) AS account,
           CAST(coalesce(u.amount, l.amount) AS DOUBLE) AS amount,
           CASE WHEN l.seq IS NULL THEN 'inserted' WHEN u.seq IS NULL THEN 'untouched' ELSE 'updated' END AS outcome
    FROM ledger l FULL JOIN u ON l.seq = u.seq AND l.account = u.account""", "ledger")
def upsert(v):
    account = F.when(F.col("l_returnflag") == "R", F.col("l_linenumber").cast("string")).otherwise("new")
    updates = v.source("lineitem").groupBy(F.col("l_orderkey").alias("seq"), account.alias("account")).agg(
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("decimal(38,2)").alias("amount")
    )
    out = U.upsert(v.ledger(), updates, ["seq", "account"], ["amount"])
    return out.withColumn("amount", F.col("amount").cast("double"))


@query("""
    SELECT period, form, unit, ref, variable,
           CASE WHEN variable = 'price' AND period >= 1999 THEN CAST(CAST(trunc(CAST(value AS DOUBLE)) AS BIGINT) AS VARCHAR)
                ELSE value END AS value FROM observations""", "observations")
def replace_scope(v):
    obs = v.observations()
    rounded = FL.with_numeric_value(obs.where("variable = 'price' and period >= 1999")).withColumn(
        "value", F.col("value").cast("string")
    )
    return U.replace_scope(obs, rounded, rounded.select("period", "variable"))


# --- change log ------------------------------------------------------------------------


def _event_edits(v):
    """Every event is an edit of its user's cell named after the event type."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    new = F.when(F.col("value") >= 1, F.col("value"))
    return v.source("events").withColumn("new", new).select(
        F.col("user_id"), F.col("event_type").alias("colId"), F.col("event_id").alias("seq"),
        # Seen as a log, the first edit of a cell finds 0.
        F.when(F.row_number().over(w) == 1, F.lit(0.0)).otherwise(F.lag("new").over(w)).alias("oldValue"),
        F.col("new").alias("value"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"),
        F.lit("REVIEW").alias("reason"), F.concat(F.lit("line\n"), "props").alias("comment"),
    )


EDIT_META = {"statistics_name": "events", "data_source": "users.parquet", "data_period": "2024", "changed_by": "editor"}


def _event_log(v):
    edits = _event_edits(v)
    log = E.build_log(edits, ["user_id"], EDIT_META)
    return edits, log


CELL_TYPES = ("click", "error", "purchase", "signup", "view")


def _event_base(v):
    return v.source("events").select("user_id").distinct().select("user_id", *[F.lit(0.0).alias(t) for t in CELL_TYPES])


EDIT_SQL = """
    edits AS (
        SELECT user_id, event_type, event_id, ts, props, CASE WHEN value >= 1 THEN value END AS new,
               CASE WHEN row_number() OVER w = 1 THEN 0.0::DOUBLE ELSE lag(CASE WHEN value >= 1 THEN value END) OVER w END AS old
        FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))"""


@query(f"""
    WITH {EDIT_SQL}
    SELECT event_type AS variable_name, 'M' AS change_event, 'REVIEW' AS change_event_reason, 'UPD' AS data_change_type,
           date_trunc('millisecond', ts) AS change_datetime, 'line' || props AS change_comment,
           CAST(user_id AS VARCHAR) AS unit_id, coalesce(CAST(old AS VARCHAR), 'None') AS old_value,
           coalesce(CAST(new AS VARCHAR), 'None') AS new_value FROM edits""")
def build_log(v):
    return _flat(_event_log(v)[1])


def _flat(log):
    d = F.col("change_details")
    return log.select(
        "variable_name", "change_event", "change_event_reason", "data_change_type",
        F.col("change_datetime").cast("timestamp_ntz").alias("change_datetime"), "change_comment",
        d["unit_id"][0]["unit_id_value"].alias("unit_id"), d["old_value"][0]["value"].alias("old_value"),
        d["new_value"][0]["value"].alias("new_value"),
    )


REPLAY_SQL = """
    SELECT user_id, {cells} FROM (
        SELECT user_id, event_type, CASE WHEN value >= 1 THEN value END AS v,
               row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events)
    GROUP BY user_id""".format(cells=", ".join(
        f"CASE WHEN count(*) FILTER (event_type = '{t}') = 0 THEN 0.0 ELSE max(v) FILTER (event_type = '{t}' AND rn = 1) END AS {t}"
        for t in CELL_TYPES))


@query(REPLAY_SQL)
def apply_log(v):
    """Replay all events as edits: the cell ends at the last event's value."""
    log = _ordered_log(v)
    return E.apply_log(_event_base(v), log, ["user_id"])


def _ordered_log(v):
    edits = _event_edits(v)
    return E.build_log(edits, ["user_id"], EDIT_META)


@query("""
    SELECT date_trunc('millisecond', ts) AS change_datetime, event_type AS variable, CAST(user_id AS VARCHAR) AS user_id,
           'stale_old_value' AS problem FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""",
       name="replay_problems")
def problems(v):
    """The same log over a base whose cells are 1: the first edit of every cell is stale."""
    ones = _event_base(v).select("user_id", *[F.lit(1.0).alias(t) for t in CELL_TYPES])
    found = E.replay_log(ones, _ordered_log(v), ["user_id"])[1]
    return found.select(F.col("change_datetime").cast("timestamp_ntz").alias("change_datetime"), "variable", "user_id", "problem")


@query(f"""
    WITH {EDIT_SQL}
    SELECT date_trunc('millisecond', ts) AS change_datetime, 0 AS cell_no, event_type AS variable, 'user_id=' || user_id AS unit,
           coalesce(CAST(old AS VARCHAR), 'None') AS old_value, coalesce(CAST(new AS VARCHAR), 'None') AS new_value,
           'editor' AS changed_by, 'line' || props AS change_comment, 'users.parquet' AS data_source,
           'data_target_placeholder' AS data_target FROM edits""")
def log_report(v):
    report = E.log_report(_event_log(v)[1])
    return report.withColumn("change_datetime", F.col("change_datetime").cast("timestamp_ntz"))


def _two_cell_log(v):
    """The event log with a second cell in every row: how many edits its user had before, and now."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    turns = v.source("events").select(F.col("event_id").alias("seq"), n.alias("n"))

    def with_count(part, value):
        added = F.array(F.struct(F.lit("edits").alias("variable_name"), value.cast("string").alias("value")))
        return F.concat(F.col("change_details")[part], added)

    details = F.col("change_details")
    details = details.withField("old_value", with_count("old_value", F.col("n") - 1)).withField("new_value", with_count("new_value", F.col("n")))
    return _ordered_log(v).join(turns, "seq").withColumn("change_details", details).drop("n")


@query(REPLAY_SQL.replace("SELECT user_id, CASE", "SELECT user_id, count(*) AS edits, CASE", 1))
def apply_log_cells(v):
    """Every log row changes two cells of its user."""
    base = _event_base(v).withColumn("edits", F.lit(0).cast("long"))
    return E.apply_log(base, _two_cell_log(v), ["user_id"])


@query(f"""
    WITH {EDIT_SQL}
    SELECT event_type AS variable_name, 'M' AS change_event, 'REVIEW' AS change_event_reason, 'UPD' AS data_change_type,
           date_trunc('millisecond', ts) AS change_datetime, 'line' || props AS change_comment,
           CAST(user_id AS VARCHAR) AS unit_id, coalesce(CAST(old AS VARCHAR), 'None') AS old_value,
           coalesce(CAST(new AS VARCHAR), 'None') AS new_value FROM edits""")
def read_change_log(v):
    path = scratch_path(v.spark, "log")
    logs.write_change_log(_event_log(v)[1], path)
    return _flat(logs.read_change_log(v.spark, path))


@query(REPLAY_SQL)
def export_edited(v):
    """Store the table and its log, export both, and read the exported table."""
    root = scratch_path(v.spark, "export")
    source, target = f"{root}/inndata/users.parquet", f"{root}/utdata/users.parquet"
    _event_base(v).write.parquet(source)
    logs.write_change_log(_event_log(v)[1], logs.log_path(source))
    logs.export_edited(v.spark, source, target)
    return v.spark.read.parquet(target)


@query("SELECT *, (\"column\" = 'value') AS editable FROM (SELECT ref, CASE WHEN edited THEN 'value' ELSE 'variable' END AS \"column\" FROM receipts)",
       "receipts")
def editable(v):
    edits = v.receipts().select("ref", F.when(F.col("edited"), "value").otherwise("variable").alias("column"))
    return E.editable(edits, "long")


EDITS_SQL = """
    edits AS MATERIALIZED (
        SELECT CAST(l_orderkey AS VARCHAR) AS ref,
               CASE WHEN max(l_returnflag) = 'A' THEN 'remark' ELSE 'lines' END AS variable,
               CASE WHEN max(l_discount) > 0.09 THEN '0' ELSE CAST(count(*) AS VARCHAR) END AS old_value,
               CASE WHEN min(l_discount) > 0.03 THEN '1.5' ELSE CAST(count(*) + 1 AS VARCHAR) END AS value
        FROM lineitem GROUP BY l_orderkey),
    judged AS MATERIALIZED (
        SELECT e.*, CASE
            WHEN e.variable = 'lines' AND contains(e.value, '.') THEN 'datatype float'
            WHEN o.ref IS NOT NULL AND o.value <> e.old_value THEN 'old value differs' END AS reason, o.ref IS NULL AS fresh
        FROM edits e LEFT JOIN observations o ON o.ref = e.ref AND o.variable = e.variable)"""


def _cell_edits(v):
    """One edit per response: of its line count, or of a variable it does not have yet."""
    n = F.count("*")
    return v.source("lineitem").groupBy("l_orderkey").agg(
        F.when(F.max("l_returnflag") == "A", "remark").otherwise("lines").alias("variable"),
        F.when(F.max("l_discount") > 0.09, "0").otherwise(n.cast("string")).alias("old_value"),
        F.when(F.min("l_discount") > 0.03, "1.5").otherwise((n + 1).cast("string")).alias("value"),
    ).select(F.col("l_orderkey").cast("string").alias("ref"), "variable", "old_value", "value")


@query(f"""
    WITH {EDITS_SQL}
    SELECT ref, variable, old_value, value, reason,
           CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN fresh THEN 'inserted' ELSE 'updated' END AS outcome FROM judged""",
       "observations")
def edit_outcomes(v):
    return E.edit_outcomes(v.observations(), _cell_edits(v), ["ref"], v.types(), insert_missing=True)


@query(f"""
    WITH {EDITS_SQL}
    SELECT o.ref, o.variable, coalesce(j.value, o.value) AS value FROM observations o
    LEFT JOIN judged j ON j.ref = o.ref AND j.variable = o.variable AND j.reason IS NULL
    UNION ALL SELECT ref, variable, value FROM judged WHERE fresh AND reason IS NULL""", "observations")
def edit_values(v):
    out = E.edit_values(v.observations(), _cell_edits(v), ["ref"], v.types(), insert_missing=True)
    return out.select("ref", "variable", "value")


@query("""
    SELECT r.*, CASE WHEN r.status = 'Ubehandlet' AND EXISTS (SELECT 1 FROM lineitem l
        WHERE CAST(l.l_orderkey AS VARCHAR) = r.ref AND l.l_returnflag = 'R') THEN 'Under arbeid' ELSE r.status END AS new_status
    FROM receipts r""", "receipts")
def advance_status(v):
    edited = v.source("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").cast("string").alias("ref"))
    receipts = v.receipts()
    return E.advance_status(receipts.withColumn("before", F.col("status")), edited).withColumnsRenamed(
        {"status": "new_status", "before": "status"}
    )


@query("""
    SELECT ref, variable, new_value, strftime(changed_at + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS changed_at, process_type, hist_id
    FROM changes WHERE process_type <> 'Altinn3'""", "changes")
def history(v):
    return E.history(v.changes())


# --- comments --------------------------------------------------------------------------

COMMENT_KEYS = "coalesce(unit, '') || '|' || level || '|' || coalesce(variable, '')"


@query(f"""
    WITH keys AS (SELECT DISTINCT {COMMENT_KEYS} AS k FROM comments WHERE active AND created_at >= TIMESTAMP '2024-01-29')
    SELECT id, unit, level, variable, active AND {COMMENT_KEYS} NOT IN (SELECT k FROM keys) AS active FROM comments
    UNION ALL SELECT DISTINCT -1, unit, level, variable, true FROM comments
    WHERE active AND created_at >= TIMESTAMP '2024-01-29'""", "comments")
def add_comment(v):
    """New comments on every key that was commented on in the last days."""
    comments = v.comments()
    recent = comments.where("active and created_at >= timestamp_ntz'2024-01-29'").select("unit", "level", "variable").distinct()
    new = recent.select(
        F.lit(-1).cast("bigint").alias("id"), "unit", "level", "variable", F.lit("checked").alias("comment"),
        F.lit("2024-02-01 00:00:00").cast("timestamp_ntz").alias("created_at"), F.lit("editor").alias("created_by"),
    )
    return CM.add_comment(comments, new).select("id", "unit", "level", "variable", "active")


@query(f"""
    WITH firsts AS (SELECT min(id) AS id FROM comments GROUP BY {COMMENT_KEYS})
    SELECT id, unit, level, variable, id IN (SELECT id FROM firsts) AS active FROM comments""", "comments")
def activate_comment(v):
    """The oldest comment of every key becomes the active one."""
    comments = v.comments()
    firsts = comments.groupBy("unit", "level", "variable").agg(F.min("id").alias("id"))
    return CM.activate_comment(comments, firsts).select("id", "unit", "level", "variable", "active")


@query("SELECT id, unit, active AND level <> 'general' AS active FROM comments", "comments")
def deactivate_comment(v):
    comments = v.comments()
    return CM.deactivate_comment(comments, comments.where("level = 'general'")).select("id", "unit", "active")


# --- sources and sinks -----------------------------------------------------------------


@query("SELECT CAST(period AS BIGINT) AS period, form, unit, ref, variable, value FROM observations WHERE period IN (1997, 1998)",
       "observations")
def partitioned_round_trip(v):
    """Write the observations in their layout and read two periods' folders back."""
    path = scratch_path(v.spark, "observations")
    tables.write_partitioned(v.observations(), path, "observations")
    chosen = tables.extend_previous_period(tables.partition_filter(["period"], period=1998), "period")
    back = tables.scan_table(v.spark, path, chosen)
    return back.select(F.col("period").cast("bigint").alias("period"), "form", "unit", "ref", "variable", "value")


@query("""
    WITH p AS (SELECT * FROM latest_per_period),
    s AS (SELECT variable, sum(v) FILTER (o.period = 1998) AS cur, sum(v) FILTER (o.period = 1997) AS prev
          FROM numeric_observations o JOIN p USING (ref) WHERE o.period IN (1997, 1998) GROUP BY variable)
    SELECT variable, CAST(cur AS BIGINT) AS "1998", CAST(prev AS BIGINT) AS "1997", CAST(cur - prev AS BIGINT) AS diff,
           round(CAST(coalesce(cur, 0) - coalesce(prev, 0) AS DOUBLE) / coalesce(prev, 1) * 100, 2) AS pdiff FROM s""",
       "latest_per_period numeric_observations", name="period_report")
def stored_period_report(v):
    """``period_totals`` from stored tables, reading two periods only."""
    root = scratch_path(v.spark, "survey")
    tables.write_partitioned(v.receipts(), f"{root}/receipts", "receipts")
    tables.write_partitioned(v.observations(), f"{root}/observations", "observations")
    types = v.receipts().select("period").distinct().select(
        "period", F.inline(F.array(*[
            F.struct(F.lit(n).alias("variable"), F.lit(t).alias("datatype"), F.lit(r).alias("rowno"))
            for n, t, r in (("quantity", "int", 1), ("price", "number", 2), ("lines", "integer", 3), ("flag", "string", 4))
        ]))
    )
    tables.write_partitioned(types, f"{root}/types", "types")
    return period_report(v.spark, root, 1998)


@query("SELECT * FROM part")
def read_parquet_checked(v):
    return tables.read_parquet_checked(v.spark, f"{v.path}/part.parquet", ["p_partkey"])


@query("SELECT c_custkey, '' AS code, c_name, c_mktsegment FROM customer")
def read_delimited(v):
    path = scratch_path(v.spark, "csv")
    customer = v.source("customer").select("c_custkey", F.lit("").alias("code"), "c_name", "c_mktsegment")
    customer.write.options(sep=";", header=True, emptyValue='""').csv(path)
    return tables.read_delimited(v.spark, [path], "c_custkey bigint, code string, c_name string, c_mktsegment string")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS unit, s_name AS name, '' AS sector FROM supplier")
def read_first_available(v):
    sources = [
        tables.Source(f"{v.path}/no_such_year.parquet", {"s_suppkey": "unit"}),
        tables.Source(f"{v.path}/supplier.parquet", {"s_suppkey": "unit", "s_name": "name"}),
        tables.Source(f"{v.path}/customer.parquet", {"c_custkey": "unit", "c_name": "name"}),
    ]
    return tables.read_first_available(v.spark, sources, ["unit", "name", "sector"], "unit")


@query("SELECT form, count(*) AS n FROM receipts WHERE period = 1998 AND active GROUP BY form", "receipts")
def free_search(v):
    receipts = v.receipts().withColumn("row_id", F.lit(1))
    return search(
        v.spark, "SELECT form, count(*) AS n, max(row_id) AS row_id FROM receipts WHERE active GROUP BY form",
        {"receipts": receipts}, {"period": 1998},
    )


# --- streams ---------------------------------------------------------------------------


@query("""
    SELECT CAST(received_at AS DATE) AS day, count(*) AS n FROM receipts
    WHERE CAST(received_at AS DATE) + INTERVAL 1 DAY <= (SELECT max(received_at) FROM receipts) - INTERVAL 2 DAY GROUP BY 1""",
       "receipts", name="stream_daily_receipts")
def streamed_days(v):
    """Counts of the days that the watermark has closed."""
    spark, root = v.spark, scratch_path(v.spark, "stream")
    stream = _receipt_stream(v, root)
    run = (
        stream_daily_receipts(stream).writeStream.outputMode("append").format("parquet")
        .option("path", f"{root}/days").option("checkpointLocation", f"{root}/state-days")
        .trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.read.parquet(f"{root}/days").select("day", "n")


@query("SELECT period, unit, form, ref, received_at, edited, active, status FROM latest", "latest", "stream_latest_active")
def streamed_latest(v):
    """The latest response per unit after all batches of a stream."""
    root = scratch_path(v.spark, "stream")
    run = stream_latest_active(_receipt_stream(v, root), f"{root}/latest", f"{root}/state-latest", 3, availableNow=True)
    run.awaitTermination()
    return current_latest_active(v.spark, f"{root}/latest")


@query("SELECT CAST(received_at AS DATE) AS day, count(*) AS n FROM receipts GROUP BY 1", "receipts", "stream_all_days")
def streamed_all_days(v):
    """Complete daily counts of a stream that was stopped and started anew with a fresh checkpoint."""
    root = scratch_path(v.spark, "stream")
    stream = _receipt_stream(v, root)
    for turn in range(2):
        run = stream_latest_active(stream, f"{root}/latest", f"{root}/state-{turn}", 3, availableNow=True)
        run.awaitTermination()
    return current_daily_receipts(v.spark, f"{root}/latest")


@query("SELECT CAST(received_at AS DATE) AS day, count(*) AS n FROM receipts GROUP BY 1", "receipts", "stream_daily_counts")
def streamed_daily_counts(v):
    """Daily counts kept up by a stream in update mode, stopped and started again."""
    root = scratch_path(v.spark, "stream")
    stream = _receipt_stream(v, root)
    for _ in range(2):
        start_daily_receipts(stream, f"{root}/days", f"{root}/state", availableNow=True).awaitTermination()
    return read_daily_receipts(v.spark, f"{root}/days")


def _receipt_stream(v, root):
    """The receipts as arriving files: one per period, oldest first."""
    path = f"{root}/in"
    ordered = v.receipts().repartitionByRange(4, "received_at").sortWithinPartitions("received_at")
    ordered.write.parquet(path)
    schema = v.spark.read.parquet(path).schema
    return v.spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(path)
