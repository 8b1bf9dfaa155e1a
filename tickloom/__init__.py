"""Market-structure analytics as Spark DataFrame plans."""
