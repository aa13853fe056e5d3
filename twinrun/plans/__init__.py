"""Whole jobs: run discovery, comparison, report, context documents, example pipelines."""
