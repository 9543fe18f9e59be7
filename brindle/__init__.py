"""brindle: a DataFrame-first analytics engine with incremental queries."""
