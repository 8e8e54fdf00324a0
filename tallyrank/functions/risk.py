"""Bands, labels and actions derived from a probability."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tallyrank.contract import RISK_ACTIONS, RISK_CUTS
from tallyrank.functions.numeric import banded, _col


def risk_band(p, cuts=RISK_CUTS) -> Column:
    """LOW / MEDIUM / HIGH / CRITICAL, each cut belonging to the band above it."""
    return banded(p, list(zip(cuts, ["LOW", "MEDIUM", "HIGH"])), "CRITICAL")


def risk_action(band) -> Column:
    band = _col(band)
    pairs = [F.lit(x) for kv in RISK_ACTIONS.items() for x in kv]
    return F.element_at(F.create_map(*pairs), band)


def hard_label(p, cut: float = 0.5) -> Column:
    return (_col(p) > F.lit(cut)).cast("int")


def confidence(p) -> Column:
    p = _col(p)
    return F.greatest(p, F.lit(1.0) - p)
