"""The core's queries and their SQL equivalents, gathered from the modules that define them."""

from __future__ import annotations

import importlib

from quarrylens.operators import incremental

MODULES = ["operators.files", "operators.symbols", "operators.search", "operators.rollup", "operators.events", "operators.commands", "operators.evidence", "operators.extraction", "operators.formats", "streaming.refresh"]


def _all():
    out = {
        "p6_found": (incremental.p6_found, incremental.P6_FOUND_SQL),
        "p6_gaps": (incremental.p6_gaps, incremental.P6_GAPS_SQL),
        "p6_replay": (incremental.p6_replay, incremental.P6_REPLAY_SQL),
        "p6_unprocessed": (incremental.p6_unprocessed, incremental.P6_UNPROCESSED_SQL),
    }
    for m in MODULES:
        out |= importlib.import_module(f"quarrylens.{m}").QUERIES
    return out


def queries():
    return {k: f for k, (f, _) in _all().items()}


def oracle_sql():
    return {k: s for k, (_, s) in _all().items() if s is not None}
