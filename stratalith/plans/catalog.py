"""Imports every module that registers queries."""

from . import applied, assessments, audit_queries, code_analysis, code_corpus, corpus, records, store_queries  # noqa: F401
