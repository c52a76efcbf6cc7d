"""Question-driven table operations and measurement of the systems that answer questions, on Spark."""
