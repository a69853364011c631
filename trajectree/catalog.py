"""All queries of the engine's own operators, by name, and their SQL."""

from trajectree.operators import bands, code_features, composites, features, joins, matching, retrieval, rollups, sampling, sets, texts, trajectories, trees  # noqa: F401
from trajectree.plans import ablations, dataset  # noqa: F401
from trajectree.registry import ORACLE_SQL, QUERIES
from trajectree.streaming import first_accept  # noqa: F401

__all__ = ["ORACLE_SQL", "QUERIES"]
