"""Named queries over the fixture views, and their DuckDB oracle SQL."""
