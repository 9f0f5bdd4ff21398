"""Runtime telemetry analytics on Spark."""
