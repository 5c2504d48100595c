"""Every query of the library by name, and its SQL."""

from brookwell.plans import answer_queries, graph_queries, merge_queries, method_queries, question_queries, relation_queries, retrieval_queries, source_queries, store_queries, stream_queries, text_queries  # noqa: F401
from brookwell.plans.base import QUERIES, SQL  # noqa: F401

FLAGSHIP = "l24_naive"
