"""Sources: table bundles (parquet / JDBC) and JSON request payloads."""
