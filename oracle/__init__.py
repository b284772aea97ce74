"""Independent SQL texts, for DuckDB, of every query registered in __spark_entry__.py."""
