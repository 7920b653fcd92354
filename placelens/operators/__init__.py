"""Table-to-table operators grouped by topic."""
