"""The gridded view and the query catalogue."""
