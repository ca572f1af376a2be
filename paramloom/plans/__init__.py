"""Step graphs and their execution."""
