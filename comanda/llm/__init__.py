"""Training-data operators on Spark: duplicates, filters, mixing and token files."""
