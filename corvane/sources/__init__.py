"""Sources and sinks: directory discovery, conversation logs and published snapshots."""
