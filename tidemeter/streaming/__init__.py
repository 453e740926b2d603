"""streaming of the usage-meter engine."""
