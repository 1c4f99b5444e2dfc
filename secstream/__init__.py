"""secstream: security-event analytics as PySpark DataFrame operators and streaming queries."""
