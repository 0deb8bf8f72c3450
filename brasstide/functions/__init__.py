"""Column builders and multi-key scans shared by the operators."""
