"""Loading, idempotent ingestion and result sinks."""
