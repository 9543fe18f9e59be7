"""Plan trees, state decisions, deltas and the queries that stay up to date."""
