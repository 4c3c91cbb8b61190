"""The registered queries and their SQL oracles."""

from __future__ import annotations

from . import files, mapping, outputs, records, sequences

FLAGSHIP = "best_hit"
QUERIES = {**sequences.QUERIES, **mapping.QUERIES, **outputs.QUERIES, **records.QUERIES, **files.QUERIES}
ORACLES = {**sequences.ORACLES, **mapping.ORACLES, **outputs.ORACLES, **records.ORACLES, **files.ORACLES}
