"""Sources and sinks: table scans, fixture views, event/command envelopes."""
