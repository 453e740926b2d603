"""sources of the usage-meter engine."""
