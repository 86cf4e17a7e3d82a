"""Registered queries of the localization engine and their SQL twins."""

from __future__ import annotations

from wavefix.plans import archive, signals, spatial

QUERIES: dict = {**signals.QUERIES, **spatial.QUERIES, **archive.QUERIES}
ORACLES: dict = {**signals.ORACLES, **spatial.ORACLES, **archive.ORACLES}
