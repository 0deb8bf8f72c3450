"""Financial-research data work as Spark DataFrame operators."""
