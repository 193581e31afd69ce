"""Ledgers and reports of verdicts."""
