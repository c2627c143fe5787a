"""A query engine for OData options over Spark tables."""
