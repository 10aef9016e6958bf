"""Graph-pattern queries over tables, on Spark."""
