"""plans of the usage-meter engine."""
