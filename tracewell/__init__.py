"""Provenance analytics on PySpark: which prompt and model produced a line, and has the line drifted since."""
