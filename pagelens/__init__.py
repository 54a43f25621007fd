"""pagelens: cross-revision checking of project documents as PySpark DataFrame queries."""
