"""signalloom: cross-sectional signal analytics as Spark DataFrame operators."""
