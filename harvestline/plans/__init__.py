"""Whole jobs: a batch of runs, and the fold of their ledger."""
