"""Column functions that Spark does not have built in."""
