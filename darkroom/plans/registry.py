"""All core queries and their SQL, by name."""

from __future__ import annotations

from darkroom.plans import library, training

QUERIES = dict(library.QUERIES) | dict(training.QUERIES)
ORACLES = dict(library.ORACLES) | dict(training.ORACLES)
FLAGSHIP = "q_year_extension"
