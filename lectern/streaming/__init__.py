"""Streaming forms of the ledger."""
