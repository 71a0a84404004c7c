"""Imports the query modules of this subpackage and exposes their jobs and checks."""

from bookheat.llm import bpe_queries, classify_queries, jaccard_queries, mixing_queries, negatives_queries, secrets_queries, spelling_queries, substrings_queries, suffix_queries, vector_queries, warc_queries  # noqa: F401
from bookheat.llm.registry import CHECKS, JOBS  # noqa: F401
