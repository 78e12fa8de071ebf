"""Sources and sinks: table scans, raw JSON feeds, registry files, fixture views."""
