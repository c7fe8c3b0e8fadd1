"""Market-intelligence analytics expressed as Spark DataFrame programs."""
