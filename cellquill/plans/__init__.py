"""Plan helpers and the adapter from the driver's tables."""
