"""Aggregates, receipt monitoring, statements and outliers."""

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import filters as FL
from ..operators import latest as L
from ..operators import outliers as O
from ..operators import statement as S
from ..scratch import materialize, small_table
from .registry import query
from .selection import CHANGE_HITS, all_change_hits

SECTIONS = [*A.BALANCE_SECTIONS, *A.INCOME_SECTIONS]

SECTION_SQL = """
    sections AS (SELECT * FROM (VALUES
        ('eiendeler', 'anleggsmidler', 1000, 1399), ('eiendeler', 'omløpsmidler', 1400, 1999),
        ('egenkapital_og_gjeld', 'egenkapital', 2000, 2099), ('egenkapital_og_gjeld', 'langsiktig gjeld', 2100, 2299),
        ('egenkapital_og_gjeld', 'kortsiktig gjeld', 2300, 2999),
        ('driftsinntekter', 'salgsinntekter', 3000, 3399), ('driftsinntekter', 'andre driftsinntekter', 3400, 3999),
        ('driftskostnader', 'varekostnader', 4000, 4999), ('driftskostnader', 'lønn og kostnader til ansatte', 5000, 5999),
        ('driftskostnader', 'andre driftskostnader', 6000, 7999),
        ('finansposter og skattekostnad', 'finansinntekter', 8000, 8099),
        ('finansposter og skattekostnad', 'finanskostnader', 8100, 8299),
        ('finansposter og skattekostnad', 'skattekostnader', 8300, 8999)) t(heading, section, lo, hi)),
    signed AS (
        SELECT l.seq, s.heading, s.section,
               CASE WHEN l.account IN ('1296','1298','1299','2010','2080','2095','3300','4995','6998','7099')
                    THEN -l.amount ELSE l.amount END AS v
        FROM chart_ledger l JOIN sections s ON CAST(l.account AS INTEGER) BETWEEN s.lo AND s.hi),
    income AS (
        SELECT seq, sum(CASE WHEN section IN ('salgsinntekter', 'andre driftsinntekter', 'finansinntekter') THEN v ELSE -v END) AS v
        FROM signed WHERE heading NOT IN ('eiendeler', 'egenkapital_og_gjeld') GROUP BY seq)"""


@query("""
    WITH p AS (SELECT * FROM latest_per_period),
    s AS (SELECT variable, sum(v) FILTER (o.period = 1998) AS cur, sum(v) FILTER (o.period = 1997) AS prev
          FROM numeric_observations o JOIN p USING (ref) WHERE o.period IN (1997, 1998) GROUP BY variable)
    SELECT variable, CAST(cur AS BIGINT) AS "1998", CAST(prev AS BIGINT) AS "1997", CAST(cur - prev AS BIGINT) AS diff,
           round(CAST(coalesce(cur, 0) - coalesce(prev, 0) AS DOUBLE) / coalesce(prev, 1) * 100, 2) AS pdiff FROM s""",
       "latest_per_period numeric_observations")
def period_totals(v):
    return A.period_totals(v.observations(), v.receipts(), v.types(), 1998)


@query("""
    WITH u AS (SELECT unit, sum(v) AS v FROM numeric_observations WHERE variable = 'price' GROUP BY unit)
    SELECT unit, round(CAST(v AS DOUBLE) / (SELECT CAST(sum(v) AS DOUBLE) FROM u) * 100, 2) AS share
    FROM u ORDER BY v DESC, unit LIMIT 10""", "numeric_observations")
def contributions(v):
    return A.contributions(v.observations(), "price")


@query("""
    SELECT variable, CAST(sum(CAST(trunc(TRY_CAST(value AS DOUBLE)) AS BIGINT)) AS BIGINT) AS total
    FROM observations GROUP BY variable""", "observations")
def totals_by_variable(v):
    return A.totals_by_variable(v.observations())


@query("""
    SELECT left(municipality, 2) AS county, municipality, CAST(sum(v) AS BIGINT) AS total,
           CASE grouping(left(municipality, 2), municipality) WHEN 0 THEN 'municipality' WHEN 1 THEN 'county' ELSE 'all' END AS level
    FROM numeric_observations LEFT JOIN municipalities USING (unit) WHERE variable = 'quantity'
    GROUP BY ROLLUP (left(municipality, 2), municipality)""", "numeric_observations municipalities")
def totals_by_region(v):
    return A.totals_by_region(v.observations(), A.regional_attributes(v.unit_info()), "quantity")


@query("""
    SELECT unit, ref, v AS value, municipality FROM numeric_observations JOIN municipalities USING (unit)
    WHERE variable = 'quantity'""", "numeric_observations municipalities")
def units_in_region(v):
    out = A.units_in_region(v.observations(), A.regional_attributes(v.unit_info()), "quantity")
    return out.select("unit", "ref", "value", "municipality")


@query("""
    SELECT seq, CAST(sum(amount) FILTER (account = '1') AS DOUBLE) AS a1, CAST(sum(amount) FILTER (account = '2') AS DOUBLE) AS a2,
           CAST(sum(amount) FILTER (account = 'total') AS DOUBLE) AS total FROM ledger GROUP BY seq""", "ledger")
def wide_statement(v):
    wide = A.wide_statement(v.ledger(), ["1", "2", "total"])
    return wide.select("seq", *[F.col(c).cast("double").alias(n) for c, n in (("1", "a1"), ("2", "a2"), ("total", "total"))])


@query("""
    SELECT unit, avg(v) FILTER (variable = 'quantity') AS quantity, avg(v) FILTER (variable = 'price') AS price,
           bool_or(ref = '0') AS highlight
    FROM numeric_observations WHERE variable IN ('quantity', 'price') GROUP BY unit""", "numeric_observations")
def variables_side_by_side(v):
    return A.variables_side_by_side(v.observations(), ["quantity", "price"], "0")


@query(f"""
    WITH {CHANGE_HITS}, c AS (SELECT DISTINCT period, form, 'large_change' AS control_id FROM receipts),
    h AS (SELECT form || CAST(period AS VARCHAR) AS control_id, unit, ref, hit FROM hits)
    SELECT c.form || CAST(c.period AS VARCHAR) AS control_id,
           count(*) FILTER (h.hit) AS n_hits,
           count(*) FILTER (h.hit AND r.active AND r.status = 'Ubehandlet') AS n_untreated
    FROM c LEFT JOIN h ON h.control_id = c.form || CAST(c.period AS VARCHAR)
    LEFT JOIN receipts r ON r.unit = h.unit AND r.ref = h.ref GROUP BY 1""", "observations latest_per_period")
def control_overview(v):
    name = F.concat("form", F.col("period").cast("string"))
    controls = v.receipts().select(name.alias("control_id")).distinct()
    hits = all_change_hits(v).withColumn("control_id", name)
    return A.control_overview(controls, hits, v.receipts())


@query("SELECT CAST(received_at AS DATE) AS day, count(*) AS n FROM receipts GROUP BY 1", "receipts")
def daily_receipts(v):
    return A.daily_receipts(v.receipts())


@query("""
    WITH l AS (SELECT unit, max(received_at) AS received_at FROM receipts GROUP BY unit),
    t AS (SELECT received_at, count(*) AS n FROM l GROUP BY 1)
    SELECT received_at, n, CAST(sum(n) OVER (ORDER BY received_at) AS BIGINT) AS cumulative,
           (SELECT count(*) FROM units) AS n_frame,
           round(CAST(sum(n) OVER (ORDER BY received_at) AS DOUBLE) * 100.0 / (SELECT count(*) FROM units), 6) AS share FROM t""",
       "receipts units")
def cumulative_receipts(v):
    return A.cumulative_receipts(v.receipts(), v.units()).withColumn("share", F.round("share", 6))


@query(f"""
    WITH {SECTION_SQL}, seqs AS (SELECT DISTINCT seq FROM signed)
    SELECT seq, 'section' AS kind, heading, section, CAST(nullif(coalesce(sum(v), 0), 0) AS DOUBLE) AS amount
    FROM (SELECT q.seq, s.heading, s.section, g.v FROM seqs q CROSS JOIN sections s
          LEFT JOIN signed g ON g.seq = q.seq AND g.section = s.section) GROUP BY 1, 3, 4
    UNION ALL
    SELECT seq, 'heading', heading, heading, CAST(nullif(coalesce(sum(v), 0), 0) AS DOUBLE)
    FROM (SELECT q.seq, s.heading, g.v FROM seqs q CROSS JOIN (SELECT DISTINCT heading FROM sections) s
          LEFT JOIN signed g ON g.seq = q.seq AND g.heading = s.heading) GROUP BY 1, 3
    UNION ALL
    SELECT q.seq, 'result', 'årsresultat', 'årsresultat', CAST(nullif(coalesce(i.v, 0), 0) AS DOUBLE)
    FROM seqs q LEFT JOIN income i USING (seq)""", "chart_ledger")
def section_totals(v):
    out = A.section_totals(v.chart_ledger(), SECTIONS, result_terms=A.RESULT_TERMS)
    return out.withColumn("amount", F.col("amount").cast("double"))


@query(f"WITH {CHANGE_HITS} SELECT control_id, hit, count(*) AS n FROM hits GROUP BY 1, 2", "observations latest_per_period")
def hit_counts(v):
    return A.hit_counts(all_change_hits(v))


QUARTILE_SQL = """
    q AS (SELECT variable, count(*) AS n, CAST(min(v) AS DOUBLE) AS minimum, quantile_cont(CAST(v AS DOUBLE), 0.25) AS q1,
                 quantile_cont(CAST(v AS DOUBLE), 0.5) AS median, quantile_cont(CAST(v AS DOUBLE), 0.75) AS q3,
                 CAST(max(v) AS DOUBLE) AS maximum FROM numeric_observations GROUP BY variable)"""


@query(f"""
    WITH {QUARTILE_SQL}
    SELECT *, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM q""", "numeric_observations")
def distribution(v):
    return A.distribution(v.observations())


@query(f"""
    WITH {QUARTILE_SQL}
    SELECT ref, variable, v AS value, NOT v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS outlier
    FROM numeric_observations JOIN q USING (variable)""", "numeric_observations")
def distribution_points(v):
    return A.distribution_points(v.observations()).select("ref", "variable", "value", "outlier")


@query("""
    WITH e AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 20 AS w FROM orders),
    b AS (SELECT lo, w, CAST(least(floor((o_totalprice - lo) / w), 19) AS INTEGER) AS bin FROM orders, e)
    SELECT bin, lo + bin * w AS from_x, lo + (bin + 1) * w AS to_x, count(*) AS n FROM b GROUP BY bin, lo, w""")
def histogram(v):
    return A.histogram(v.source("orders"), "o_totalprice")


# --- statements ------------------------------------------------------------------------


@query("SELECT * FROM ledger WHERE amount > 50000 OR account = 'total' OR account = '1'", "ledger", "filter_reported")
def reported(v):
    """Lines without an amount above 50000 count as blank; account 1 stands for a sum line."""
    rows = v.ledger().withColumn("value", F.when(F.col("amount") > 50000, F.col("amount")))
    text = F.when(F.col("account") == "total", "Egenkapital").when(F.col("account") == "1", "SUM x").otherwise("line")
    return FL.filter_reported(rows.withColumn("description", text)).select("seq", "account", "amount")


STATEMENT_SQL = """
    subs AS (SELECT o.seq, b.seq AS compare_seq, o.unit
             FROM (SELECT * FROM p WHERE period = 1998) o LEFT JOIN (SELECT * FROM p WHERE period = 1997) b USING (unit)),
    catalogue AS (SELECT account, 'Line ' || account AS text,
                         CASE account WHEN 'total' THEN 8 ELSE CAST(account AS INTEGER) END AS line_no
                  FROM (SELECT DISTINCT account FROM ledger)
                  UNION ALL SELECT '', 'Eiendeler', 0),
    lines AS (SELECT s.seq, s.compare_seq, s.unit, c.line_no, c.account, c.text AS description, a.amount AS value,
                     b.amount AS compare_value
              FROM subs s CROSS JOIN catalogue c
              LEFT JOIN ledger a ON a.seq = s.seq AND a.account = c.account
              LEFT JOIN ledger b ON b.seq = s.compare_seq AND b.account = c.account)"""


def _submissions(v):
    active = L.active_version(v.versions(), v.update_counts())
    now = active.where("period = 1998").select("seq", "unit")
    then = active.where("period = 1997").select(F.col("seq").alias("compare_seq"), "unit")
    # What to show is a chosen list in practice; here it is derived, so store it once.
    return materialize(now.join(then, "unit", "left"))


def _catalogue(v):
    codes = v.ledger().select("account").distinct().select(
        "account", F.concat(F.lit("Line "), "account").alias("text"),
        F.when(F.col("account") == "total", 8).otherwise(F.col("account").try_cast("int")).alias("line_no"),
    )
    return codes.unionByName(small_table(v.spark, [("", "Eiendeler", 0)], "account string, text string, line_no int"))


ACTIVE_SQL = """
    p AS (SELECT * FROM counted
          QUALIFY row_number() OVER (PARTITION BY unit, period ORDER BY n_changes > 0 DESC, received_at DESC, seq DESC) = 1)"""


@query(f"""
    WITH {ACTIVE_SQL}, {STATEMENT_SQL}
    SELECT seq, compare_seq, line_no, account, description, CAST(value AS DOUBLE) AS value,
           CAST(compare_value AS DOUBLE) AS compare_value,
           CAST(CASE WHEN compare_seq IS NOT NULL AND (value IS NOT NULL OR compare_value IS NOT NULL)
                THEN coalesce(value, 0) - coalesce(compare_value, 0) END AS DOUBLE) AS diff,
           m.comment
    FROM lines LEFT JOIN (SELECT unit, variable, comment FROM comments WHERE active AND level = 'variable'
        QUALIFY row_number() OVER (PARTITION BY unit, variable ORDER BY created_at DESC, id DESC) = 1) m
      ON m.unit = lines.unit AND m.variable = lines.account""", "counted ledger comments")
def statement(v):
    out = S.statement(v.ledger(), _catalogue(v), _submissions(v), v.comments()).drop("unit")
    money = {c: F.col(c).cast("double") for c in ("value", "compare_value", "diff")}
    return out.withColumns(money)


@query(f"""
    WITH {ACTIVE_SQL}, {STATEMENT_SQL},
    sums AS (SELECT seq, CASE WHEN CAST(account AS INTEGER) <= 3 THEN 'low' ELSE 'high' END AS section,
                    sum(CASE WHEN account = '2' THEN -amount ELSE amount END) AS v
             FROM ledger WHERE account <> 'total' GROUP BY 1, 2),
    totals AS (SELECT q.seq, n.section, coalesce(s.v, 0) AS v
             FROM (SELECT DISTINCT seq FROM sums) q CROSS JOIN (VALUES ('low'), ('high')) n(section)
             LEFT JOIN sums s ON s.seq = q.seq AND s.section = n.section
             UNION ALL SELECT seq, 'all', sum(v) FROM sums GROUP BY seq)
    SELECT seq, line_no, CASE WHEN account = 'total' THEN '' ELSE account END AS account, description,
           CAST(value AS DOUBLE) AS value, 'account' AS kind FROM lines
    WHERE value IS NOT NULL OR compare_value IS NOT NULL OR description = 'Eiendeler'
    UNION ALL
    SELECT b.seq, CASE section WHEN 'low' THEN 3 WHEN 'high' THEN 7 ELSE 8 END, '', 'SUM forslag for ' || section,
           CAST(nullif(v, 0) AS DOUBLE), CASE section WHEN 'all' THEN 'heading' ELSE 'section' END
    FROM totals b JOIN subs USING (seq)""", "counted ledger")
def statement_with_sections(v):
    sections = [A.Section("all", "low", 1, 3), A.Section("all", "high", 4, 7)]
    out = S.statement_with_sections(
        v.ledger(), _catalogue(v), _submissions(v), sections, contra=["2"],
        anchors={"low": "3", "high": "7", "all": "total"},
    )
    return out.select("seq", "line_no", "account", "description", F.col("value").cast("double").alias("value"), "kind")


@query("""
    SELECT l_orderkey AS seq, 'flag' AS account, max(l_returnflag) AS value FROM lineitem GROUP BY 1
    UNION ALL SELECT l_orderkey, 'status', max(l_linestatus) FROM lineitem GROUP BY 1""")
def company_facts(v):
    return S.company_facts(_facts(v), ["flag", "status"]).select("seq", "account", "value")


@query("SELECT l_orderkey AS seq, max(l_returnflag) = 'R' AS assessed FROM lineitem GROUP BY 1")
def assessed_by_authority(v):
    return S.assessed_by_authority(_facts(v))


def _facts(v):
    """Facts per order; one counts as assessed when a line was returned."""
    wide = v.source("lineitem").groupBy(F.col("l_orderkey").alias("seq")).agg(
        F.max("l_returnflag").alias("flag"), F.max("l_linestatus").alias("status")
    )
    long = wide.unpivot(["seq"], ["flag", "status"], "account", "value")
    assessed = wide.where("flag = 'R'").select("seq", F.lit("skjoennslignet").alias("account"), F.lit("true").alias("value"))
    return long.unionByName(assessed)


# --- outliers --------------------------------------------------------------------------

HB_SQL = """
    WITH pair AS (
        SELECT c_mktsegment AS segment, o_custkey AS id,
               CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (year(o_orderdate) = 1998) AS DOUBLE) AS x1,
               CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (year(o_orderdate) = 1997) AS DOUBLE) AS x2
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
    eligible AS (
        SELECT *, x1 / x2 AS ratio FROM pair WHERE x1 > 0 AND x2 > 0
        QUALIFY x1 <> x2 OR count(*) FILTER (x1 = x2) OVER (PARTITION BY segment) * 2 < count(*) OVER (PARTITION BY segment)),
    med AS (SELECT segment, quantile_cont(ratio, 0.5) AS rm FROM eligible GROUP BY segment),
    scored AS (
        SELECT e.*, rm, pow(greatest(x1, x2), 0.5) AS w,
               CASE WHEN ratio < rm THEN 1 - rm / ratio ELSE ratio / rm - 1 END * pow(greatest(x1, x2), 0.5) AS e
        FROM eligible e JOIN med USING (segment)),
    qs AS (SELECT segment, quantile_cont(e, 0.25) AS q1, quantile_cont(e, 0.5) AS q2, quantile_cont(e, 0.75) AS q3
           FROM scored GROUP BY segment),
    lim AS (SELECT segment, q2 - {pc} * greatest(q2 - q1, abs(0.05 * q2)) AS lo, q2 + {pc} * greatest(q3 - q2, abs(0.05 * q2)) AS hi FROM qs),
    judged AS (
        SELECT id, rm, w, lo / w AS lu, hi / w AS hu, e < lo OR e > hi AS bad FROM scored JOIN lim USING (segment))
    SELECT p.id, p.segment, p.x1, p.x2, round(CASE WHEN p.x1 > 0 AND p.x2 > 0 THEN p.x1 / p.x2 END, 6) AS ratio,
           greatest(p.x1, p.x2) AS max_x,
           round(CASE WHEN lu >= 0 THEN rm * (1 + lu) ELSE rm / (1 - lu) END, 6) AS lower_limit,
           round(CASE WHEN hu >= 0 THEN rm * (1 + hu) ELSE rm / (1 - hu) END, 6) AS upper_limit,
           CAST(coalesce(bad, false) AS INTEGER) AS outlier
    FROM pair p LEFT JOIN judged j USING (id)"""


def _period_pair(v):
    price = F.col("o_totalprice").cast("decimal(18,2)")
    sums = v.source("orders").groupBy("o_custkey").agg(*[
        F.sum(F.when(F.year("o_orderdate") == y, price)).cast("double").alias(x) for y, x in ((1998, "x1"), (1997, "x2"))
    ])
    segments = v.source("customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    return sums.join(segments, F.col("o_custkey") == F.col("c_custkey"))


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("ratio", "lower_limit", "upper_limit")})


@query(HB_SQL.format(pc=2))
def hb_outliers(v):
    return _rounded(O.hb_outliers(_period_pair(v), "o_custkey", "x1", "x2", p_c=2, strata=["segment"]))


@query(HB_SQL.replace("c_mktsegment AS segment", "'all' AS segment").replace("GROUP BY 1, 2", "GROUP BY o_custkey")
       .replace("p.id, p.segment, ", "p.id, ").format(pc=20))
def hb_outliers_unstratified(v):
    return _rounded(O.hb_outliers(_period_pair(v), "o_custkey", "x1", "x2"))


@query("""
    WITH pair AS (SELECT l_orderkey AS id, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS x1,
                         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS x2 FROM lineitem GROUP BY 1)
    SELECT id, x1, x2, round(log10(x1 / x2), 6) AS log_ratio, CAST(abs(log10(x1 / x2)) > 3.2 AS INTEGER) AS outlier FROM pair""")
def thousand_errors(v):
    pair = v.source("lineitem").groupBy("l_orderkey").agg(
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("x1"),
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("x2"),
    )
    return O.thousand_errors(pair, "l_orderkey", "x1", "x2", 3.2).withColumn("log_ratio", F.round("log_ratio", 6))
