"""Runs whose result becomes the stored state: each is one transaction of a ``Store``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.comments import KEY as COMMENT_KEY
from ..operators.comments import add_comment
from ..operators.controls import sync_hits
from ..operators.upsert import upsert
from ..scratch import materialize
from ..sources.versioned import Store


@dataclass
class Committed:
    """The version a run made, and how many rows had which outcome."""

    version: int
    outcomes: dict[str, int] = field(default_factory=dict)


def _counted(rows: DataFrame, outcomes: Sequence[str], column: str = "outcome") -> tuple[DataFrame, Observation]:
    """Rows without their outcome; the counts are taken while they are written."""
    seen = Observation()
    counts = [F.count_if(F.col(column) == o).alias(o) for o in outcomes]
    return rows.observe(seen, *counts).drop(column), seen


def store_upsert(store: Store, table: str, updates: DataFrame, keys: Sequence[str], set_cols: Sequence[str],
                 label: str = "upsert") -> Committed:
    """``upsert`` into a stored table.

    Where the partition columns belong to the key, only the partitions of the updates are
    read and written.
    """
    t = store.begin()
    updates = materialize(updates)
    by = t.base.tables[table].partition_by
    scope = updates.select(*[c for c in by if c in keys])
    merged = upsert(t.read(table, scope), updates, keys, set_cols)
    rows, seen = _counted(merged, ("inserted", "updated", "untouched"))
    t.replace(table, rows, scope)
    return Committed(t.commit(label), dict(seen.get))


def store_hits(store: Store, table: str, results: DataFrame, scope_cols: Sequence[str], label: str = "control run") -> Committed:
    """``sync_hits`` with the stored hits of the partitions that the results fall into.

    The hits of responses in other partitions are ``untouched`` and stay where they are.
    """
    t = store.begin()
    results = materialize(results)
    by = t.base.tables[table].partition_by
    # the key of a hit: a partition column outside it could hold the row elsewhere
    scope = results.select(*[c for c in by if c in scope_cols or c in ("control_id", "unit", "ref")])
    rows, seen = _counted(sync_hits(t.read(table, scope), results, scope_cols), ("insert", "update", "keep", "untouched"))
    t.replace(table, rows, scope)
    return Committed(t.commit(label), dict(seen.get))


def store_replaced(store: Store, changes: Mapping[str, tuple[DataFrame, DataFrame]], label: str = "replace") -> Committed:
    """Delete and insert in several tables in one step.

    ``changes`` maps a table to its new rows and the scope to delete before.
    """
    t = store.begin()
    for table, (rows, scope) in changes.items():
        t.delete_and_insert(table, rows, scope)
    return Committed(t.commit(label))


def store_comments(store: Store, table: str, new: DataFrame, label: str = "comments") -> Committed:
    """``add_comment`` in a stored table of comments."""
    t = store.begin()
    new = materialize(new)
    by = t.base.tables[table].partition_by
    scope = new.select(*[c for c in by if c in COMMENT_KEY])
    t.replace(table, add_comment(t.read(table, scope), new), scope)
    return Committed(t.commit(label))
