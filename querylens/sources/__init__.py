"""Sources and sinks: driver tables, fixtures, JSON/JSONL/CSV log files."""
