"""CI telemetry analytics as Spark DataFrame operators."""
