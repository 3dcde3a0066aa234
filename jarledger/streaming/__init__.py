"""Structured Streaming twins of the incremental parts of the ledger."""
