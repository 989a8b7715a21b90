"""A search and analytics engine for code, documents and conversations on Apache Spark."""
