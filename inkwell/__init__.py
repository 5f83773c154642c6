"""Batch and streaming Spark jobs for a project knowledge ledger kept in tables."""
