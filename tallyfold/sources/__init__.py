"""Sources and sinks of the fact layer."""
