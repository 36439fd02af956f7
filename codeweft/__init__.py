"""codeweft: code-graph, evidence and telemetry analytics on PySpark DataFrames."""
