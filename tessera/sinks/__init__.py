"""sinks of the graph engine."""
