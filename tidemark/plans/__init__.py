"""All queries, registered by importing the modules that state them."""

from tidemark.plans import catalog, grading, reviewing, segmenting, stored, trailing  # noqa: F401
from tidemark.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
