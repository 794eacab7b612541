"""All queries of the package and their SQL."""
from rillmap.llm import queries_text  # noqa: F401 (registers its queries)
from rillmap.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
