"""Trail-network analytics as Spark DataFrame queries."""
