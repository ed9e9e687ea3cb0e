"""Column functions and the few special functions Spark lacks."""
