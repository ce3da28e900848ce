"""Account statements: catalogue lines with amounts, comparison, sums and comments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import change, exact_amount, total_type
from .aggregates import CONTRA_ACCOUNTS, section_totals
from .filters import HEADINGS, PETROLEUM_ACCOUNTS, exclude_codes, filter_reported
from .joins import Section
from .latest import latest_comment

#: Lines of the catalogue that are unfolded from one array.
PAGE_LINES = 500

# The account line after which a sum line is shown.
SUM_ANCHORS = {
    "anleggsmidler": "sumBalanseverdiForAnleggsmiddel",
    "omløpsmidler": "sumBalanseverdiForOmloepsmiddel",
    "eiendeler": "sumBalanseverdiForEiendel",
    "egenkapital": "sumEgenkapital",
    "langsiktig gjeld": "sumLangsiktigGjeld",
    "kortsiktig gjeld": "sumKortsiktigGjeld",
    "egenkapital_og_gjeld": "sumGjeldOgEgenkapital",
    "salgsinntekter": "3300",
    "andre driftsinntekter": "3911",
    "varekostnader": "4995",
    "lønn og kostnader til ansatte": "5950",
    "andre driftskostnader": "7913",
    "driftsinntekter": "sumDriftsinntekt",
    "driftskostnader": "sumDriftskostnad",
    "finansinntekter": "sumFinansinntekt",
    "finanskostnader": "sumFinanskostnad",
    "skattekostnader": "sumSkattekostnad",
    "finansposter og skattekostnad": "sumSkattekostnad",
    "årsresultat": "aarsresultat",
}


def catalogue_pages(catalogue: DataFrame, page_lines: int = PAGE_LINES) -> tuple[DataFrame, int]:
    """The catalogue ``(line_no, account, text)`` as pages of about ``page_lines`` lines, and their number.

    Counts the catalogue right away.
    """
    pages = max(1, -(-catalogue.count() // page_lines))
    line = F.struct(
        F.col("line_no").cast("int").alias("line_no"),
        F.col("account").cast("string").alias("account"), F.col("text").alias("description"),
    )
    page = F.pmod(F.xxhash64(line), F.lit(pages)).cast("int")
    return catalogue.groupBy(page.alias("__page")).agg(F.collect_list(line).alias("__lines")), pages


def statement(ledger: DataFrame, catalogue: DataFrame, submissions: DataFrame, comments: DataFrame | None = None) -> DataFrame:
    """All catalogue lines of each submission with amount, compared amount and difference.

    ``submissions(seq, compare_seq, unit)`` names what to show; ``compare_seq`` may be
    null. Many submissions are built at once, keyed by ``seq``: of the ledger only theirs
    and the compared ones are read, as one map of sums by account each, and the lines
    are unfolded last, page by page of the catalogue.
    """
    wanted = submissions.select(F.explode(F.array("seq", "compare_seq")).alias("seq")).where("seq is not null").distinct()
    sums = (
        ledger.where(F.col("account").isNotNull()).join(wanted, "seq", "left_semi")
        .groupBy("seq", "account").agg(F.sum(exact_amount(ledger)).alias("value"))
        .groupBy("seq").agg(F.map_from_entries(F.collect_list(F.struct("account", "value"))).alias("__own"))
    )
    # A submission without a partner is joined to itself and blanked: null keys would all
    # land in the same few partitions.
    paired = F.col("compare_seq").isNotNull()
    pages, n_pages = catalogue_pages(catalogue)
    both = (
        submissions.select("seq", "compare_seq", "unit", F.coalesce("compare_seq", "seq").alias("__c"))
        .join(sums, "seq", "left").join(sums.toDF("__c", "__other"), "__c", "left")
        .withColumn("__other", F.when(paired, F.col("__other")))
    )
    lines = both.withColumn("__page", F.explode(F.sequence(F.lit(0), F.lit(n_pages - 1)))).join(pages, "__page")
    out = (
        lines.select("seq", "compare_seq", "unit", "__own", "__other", F.inline("__lines"))
        .withColumn("value", F.try_element_at("__own", F.col("account")))
        .withColumn("compare_value", F.try_element_at("__other", F.col("account")))
        .withColumn("diff", F.when(paired, change("value", "compare_value")))
    )
    if comments is not None:
        notes = latest_comment(comments, "variable").select(
            "unit", F.col("variable").alias("account"), F.col("comment")
        )
        out = out.join(notes, ["unit", "account"], "left")
    return out.select(
        "seq", "compare_seq", "unit", "line_no", "account", "description", "value", "compare_value", "diff",
        *(["comment"] if comments is not None else []),
    )


def blank_text_codes(lines: DataFrame) -> DataFrame:
    """Show numeric account codes only."""
    return lines.withColumn("account", F.when(F.col("account").rlike("^[0-9]+$"), F.col("account")).otherwise(""))


def statement_with_sections(
    ledger: DataFrame, catalogue: DataFrame, submissions: DataFrame, sections: Sequence[Section],
    result_terms: Mapping[str, int] | None = None, comments: DataFrame | None = None,
    contra: Sequence[str] = CONTRA_ACCOUNTS, anchors: Mapping[str, str] = SUM_ANCHORS,
    show_blank: bool = False, show_special: bool = False, sector_units: DataFrame | None = None,
    special: Sequence[str] = PETROLEUM_ACCOUNTS, headings: Sequence[str] = HEADINGS,
) -> DataFrame:
    """The statement with each sum line placed right after its anchor account.

    ``position`` orders the lines: the anchor's line number, then account before section,
    heading and result. A sum whose anchor is missing in the catalogue is left out.
    """
    lines = statement(ledger, catalogue, submissions, comments).withColumn("kind", F.lit("account")).withColumn("rank", F.lit(0))
    rows = ledger.join(submissions.select("seq").distinct(), "seq", "left_semi")
    sums = section_totals(rows, sections, contra, result_terms)
    names = list(dict.fromkeys([*(s.name for s in sections), *(s.heading for s in sections)]))
    names += ["årsresultat"] if result_terms else []
    anchor_of = F.create_map(*[x for n in names for x in (F.lit(n), F.lit(anchors.get(n)))])
    rank = {"section": 1, "heading": 2, "result": 3}
    rank_of = F.create_map(*[x for k, v in rank.items() for x in (F.lit(k), F.lit(v))])
    position = catalogue.groupBy("account").agg(F.min(F.col("line_no").cast("int")).alias("line_no"))
    placed = (
        sums.withColumn("account", anchor_of[F.col("section")]).join(position, "account")
        .join(submissions.select("seq", "compare_seq", "unit"), "seq")
        .select(
            "seq", "compare_seq", "unit", "line_no", F.lit("").alias("account"),
            F.concat(F.lit("SUM forslag for "), F.col("section")).alias("description"),
            F.col("amount").alias("value"), F.lit(None).cast(total_type(ledger)).alias("compare_value"),
            F.lit(None).cast(total_type(ledger)).alias("diff"),
            *([F.lit(None).cast("string").alias("comment")] if comments is not None else []),
            "kind", rank_of[F.col("kind")].alias("rank"),
        )
    )
    out = lines.unionByName(placed, allowMissingColumns=True)
    if not show_blank:
        out = filter_reported(out, headings)
    out = exclude_codes(out, special, show_special, sector_units)
    return blank_text_codes(out).orderBy("seq", "line_no", "rank", "description")


def company_facts(facts: DataFrame, names: Sequence[str], seq: int | None = None) -> DataFrame:
    """Chosen key/value facts, of one submission or of all."""
    rows = facts if seq is None else facts.where(F.col("seq") == seq)
    return rows.where(F.col("account").isin(list(names))).select("seq", "account", "value")


def assessed_by_authority(facts: DataFrame, fact: str = "skjoennslignet") -> DataFrame:
    """Per submission: was it assessed by the tax authority?"""
    return facts.groupBy("seq").agg(F.max(F.col("account") == fact).alias("assessed"))
