"""Readers and writers: CSV feeds, ledger Parquet, landing folders, progress files, posts."""
