"""All queries and their SQL."""

from sketchloom.plans import accuracy  # noqa: F401  (its queries are registered on import)
from sketchloom.plans.accuracy_oracles import ORACLES as _MORE
from sketchloom.plans.exact import ORACLES as _EXACT
from sketchloom.plans.oracles import ORACLES as _ORACLES
from sketchloom.plans.queries import QUERIES
from sketchloom.plans.rollups import ORACLES as _ROLLUPS

ORACLES = _ORACLES | _MORE | _ROLLUPS | _EXACT

__all__ = ["ORACLES", "QUERIES"]
