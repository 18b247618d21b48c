"""All queries of the library but those of the training-data operators."""

from . import scalar_queries, set_queries, text_queries  # noqa: F401
from .registry import QUERIES, SQL

FLAGSHIP = "p3_document_text"

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
