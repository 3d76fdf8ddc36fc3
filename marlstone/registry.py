"""The library's queries and their SQL; the training-data operators have a registry of their own."""

from .plans import batches, builders, calls, datasets, metrics, microbatches, more, nested, reports, sequences, symbolic, texts, validation
from .plans.queries import ORACLE_SQL, QUERIES

FLAGSHIP = "advantage_group_normalised"
MODULES = [more, reports, batches, texts, metrics, nested, calls, symbolic, microbatches, datasets, validation, sequences, builders]

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
