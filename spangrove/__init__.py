"""Grammar parsing and text analytics on Spark."""
