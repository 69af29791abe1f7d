"""DataFrame operators, each keyed by source (and run)."""
