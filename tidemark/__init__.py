"""Market-data and disclosure analytics as Spark DataFrame plans."""
