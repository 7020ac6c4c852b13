"""All registered queries and their SQL twins."""

from rankwell.plans import agents, evaluation, frames, generation, nested, pooling, seeded, sessions, sources, splitting, statistics, trace  # noqa: F401
from rankwell.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
