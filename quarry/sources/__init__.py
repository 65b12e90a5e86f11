"""Sources and sinks: fixture tables, JSON run files, folder scans, writers."""

from quarry.sources.tables import Tables, TABLE_NAMES

__all__ = ["Tables", "TABLE_NAMES"]
