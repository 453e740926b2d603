"""functions of the usage-meter engine."""
