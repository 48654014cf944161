"""Imports every module of registered queries."""

from folioscope.plans import q_context, q_documents, q_evaluation, q_files, q_retrieval, q_streaming, q_usage  # noqa: F401
from folioscope.plans.registry import QUERIES, SQL  # noqa: F401
