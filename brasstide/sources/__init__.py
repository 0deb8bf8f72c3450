"""Readers, table maintenance and the tables derived from the supplied parquet."""
