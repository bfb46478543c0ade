"""Computed properties: decay curves and time to live, by the age in seconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mutate import Edges, delete_nodes

SCOPES = ("node", "field", "subtree")


def _bounded(age: Column, value: Column) -> Column:
    """NULL without an anchor; nothing is younger than new."""
    return F.when(age.isNotNull(), F.when(age <= 0, F.lit(1.0)).otherwise(value))


def linear(age: Column, duration: float) -> Column:
    return _bounded(age, F.greatest(F.lit(0.0), 1 - age / F.lit(float(duration))))


def exponential(age: Column, half_life: float) -> Column:
    return _bounded(age, F.pow(F.lit(0.5), age / F.lit(float(half_life))))


def power_law(age: Column, scale: float, exponent: float) -> Column:
    return _bounded(age, F.pow(1 + age / F.lit(float(scale)), F.lit(-float(exponent))))


def step(age: Column, steps: list[tuple[float, float]], otherwise: float = 0.0) -> Column:
    """The value of the first (limit, value) whose limit the age has not reached."""
    out = None
    for limit, value in sorted(steps):
        out = F.when(age < limit, F.lit(float(value))) if out is None else out.when(age < limit, F.lit(float(value)))
    return F.when(age.isNotNull(), out.otherwise(F.lit(float(otherwise))))


def age_of(anchor: Column, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(anchor)) / 1e6


def ttl_left(anchor: Column, seconds: float, now: Column) -> Column:
    """Seconds until expiry, not below 0."""
    return F.greatest(F.lit(0.0), F.lit(float(seconds)) - age_of(anchor, now))


def expire_nodes(rows: DataFrame, anchor: Column, seconds: float, now: Column) -> DataFrame:
    """Rows that have not expired; rows without an anchor never do."""
    return rows.where(anchor.isNull() | (age_of(anchor, now) <= seconds))


def expire_fields(rows: DataFrame, fields: list[str], anchor: Column, seconds: float, now: Column) -> DataFrame:
    """rows with the fields NULL where expired."""
    alive = anchor.isNull() | (age_of(anchor, now) <= seconds)
    return rows.withColumns({f: F.when(alive, F.col(f)) for f in fields})


def expire_subtree(rows: DataFrame, anchor: str, seconds: float, now: Column, target: str | None = None) -> DataFrame:
    """rows with the document property `target`, or the anchor where none is named, NULL where expired.

    With a target the anchor stays, so a further pass finds nothing left to do. A target that
    no row has changes nothing.
    """
    field = target or anchor
    return expire_fields(rows, [field], F.col(anchor), seconds, now) if field in rows.columns else rows


def reap(nodes: DataFrame, edges: Edges, anchor: str, seconds: float, now: Column, scope: str = "node", target: str | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """One pass over a label's nodes: expired ones go with their edges, or lose the anchor (field) or a document (subtree)."""
    if scope not in SCOPES:
        raise ValueError(f"a time to live has the scope {', '.join(SCOPES)}, not {scope}")
    if scope == "node":
        late = nodes.where(F.col(anchor).isNotNull() & (age_of(F.col(anchor), now) > seconds))
        return delete_nodes(nodes, edges, late.select("id"), detach=True)
    return expire_subtree(nodes, anchor, seconds, now, target if scope == "subtree" else None), {t: e for t, (e, _, _) in edges.items()}
