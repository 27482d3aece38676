"""Sources: night tables from files or derived from the events table."""

from nightjar.sources.nights import (
    DuplicateColumnError, NIGHT_VIEW_COLUMNS, night_view_sql, nights_from_events, normalise_column_name,
    normalise_columns, read_nights, read_table,
)

__all__ = [
    "DuplicateColumnError", "NIGHT_VIEW_COLUMNS", "night_view_sql", "nights_from_events", "normalise_column_name",
    "normalise_columns", "read_nights", "read_table",
]
