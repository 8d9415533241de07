"""Analytics on catalogs of space objects and launches, as Spark DataFrame operators."""
