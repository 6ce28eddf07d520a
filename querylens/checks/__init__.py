"""Query registrations (Spark side + DuckDB oracle), grouped by area."""
