"""Whole plans: ingestion, batch question answering, and the registered queries."""
