"""All queries of the engine, gathered by import."""

from __future__ import annotations

from marlstone.functions import arrays, dates, html, json, minhash, numbers, strings, vectors  # noqa: F401
from marlstone.operators import aggregates, eventtime, filters, joins, selection, sets, sketches, udfs, udtfs, windows  # noqa: F401
from marlstone.plans.registry import QUERIES
from marlstone.sources import files, segments, tables  # noqa: F401
from marlstone.streaming import events, stateful  # noqa: F401

__all__ = ["QUERIES"]
