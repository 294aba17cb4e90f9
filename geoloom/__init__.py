"""Geographic knowledge graphs on Spark."""
