"""Sources, sinks and archive names."""
