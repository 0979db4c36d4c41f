"""Incremental ledger ingest."""
