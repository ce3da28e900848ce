"""Column names, table schemas and fixed vocabularies of the survey data model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Column names of the Norwegian survey tables and our names for them.
ENGLISH_NAMES = {
    "aar": "period",
    "ident": "unit",
    "skjema": "form",
    "refnr": "ref",
    "variabel": "variable",
    "verdi": "value",
    "dato_mottatt": "received_at",
    "editert": "edited",
    "aktiv": "active",
    "kommentar": "comment",
    "kontrollid": "control_id",
    "utslag": "hit",
    "beskrivelse": "description",
    "tabell": "table_name",
    "radnr": "rowno",
    "sekvensnummer": "seq",
    "felt": "account",
    "belop": "amount",
    "orgnr": "unit",
    "antall_endringer": "n_changes",
    "versjon_nr": "version_no",
    "antall_versjoner": "n_versions",
}

# Processing states of a response.
UNTREATED = "Ubehandlet"
IN_PROGRESS = "Under arbeid"
FINISHED = "Ferdig"

# Fixed value: process type of the initial load of a response.
INITIAL_LOAD = "Altinn3"

# Logical types that count as numeric.
NUMERIC_TYPES = ("number", "int", "float", "integer")

# Tables that are partitioned by form as well as by period.
FORM_PARTITIONED = ("receipts", "observations", "controls", "control_hits", "contacts")

# Primary keys (without the period columns) of the core tables.
PRIMARY_KEYS = {
    "receipts": ("form", "unit", "ref"),
    "contacts": ("form", "unit", "ref"),
    "units": ("unit", "form"),
    "unit_info": ("unit", "variable"),
    "controls": ("form", "control_id"),
    "control_hits": ("form", "control_id", "unit", "ref"),
    "types": ("table_name", "variable"),
    "observations": ("form", "unit", "ref", "variable"),
}

# Foreign keys, child table -> (parent table, key columns without the period columns).
FOREIGN_KEYS = {
    "receipts": [("units", ("unit",))],
    "contacts": [("units", ("unit",)), ("receipts", ("form", "unit", "ref"))],
    "control_hits": [
        ("controls", ("form", "control_id")),
        ("units", ("unit",)),
        ("receipts", ("form", "unit", "ref")),
    ],
    "observations": [("receipts", ("form", "unit", "ref"))],
}


def core_schemas(periods: Sequence[str] = ("period",)) -> dict[str, T.StructType]:
    """Schemas of the core tables for the given period columns."""
    string, boolean = T.StringType(), T.BooleanType()
    columns: dict[str, list[tuple[str, T.DataType]]] = {
        "receipts": [
            ("unit", string), ("form", string), ("ref", string),
            ("received_at", T.TimestampType()), ("edited", boolean),
            ("comment", string), ("active", boolean),
        ],
        "contacts": [
            ("unit", string), ("form", string), ("ref", string),
            ("contact_person", string), ("email", string), ("phone", string),
            ("contact_confirmed", string), ("contact_comment", string),
            ("burden_comment", string),
        ],
        "units": [("unit", string), ("form", string)],
        "unit_info": [("unit", string), ("variable", string), ("value", string)],
        "controls": [
            ("form", string), ("control_id", string), ("kind", string),
            ("description", string), ("sort_by", string), ("sort_order", string),
        ],
        "control_hits": [
            ("form", string), ("unit", string), ("ref", string),
            ("control_id", string), ("hit", boolean), ("value", T.IntegerType()),
        ],
        "types": [
            ("table_name", string), ("rowno", T.ShortType()), ("variable", string),
            ("datatype", string), ("description", string),
        ],
        "observations": [
            ("form", string), ("unit", string), ("ref", string),
            ("variable", string), ("value", string),
        ],
    }
    lead = [T.StructField(p, T.LongType()) for p in periods]
    return {
        name: T.StructType(lead + [T.StructField(c, t) for c, t in cols])
        for name, cols in columns.items()
    }


def partition_columns(table: str, periods: Sequence[str] = ("period",)) -> list[str]:
    """Storage layout: period columns, and form for the tables that carry it per response."""
    return [*periods, "form"] if table in FORM_PARTITIONED else list(periods)


def is_long(df: DataFrame) -> bool:
    """A table is in long format when it has both a variable and a value column."""
    return "variable" in df.columns and "value" in df.columns


def to_english(df: DataFrame) -> DataFrame:
    """Rename the Norwegian survey columns that are present."""
    return df.withColumnsRenamed({k: v for k, v in ENGLISH_NAMES.items() if k in df.columns})
