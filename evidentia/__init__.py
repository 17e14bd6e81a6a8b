"""Project-evidence analytics on PySpark: graph, scope, history, telemetry and text operators."""
