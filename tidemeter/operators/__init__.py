"""operators of the usage-meter engine."""
