"""Sequential algorithms in plain Python, usable without Spark."""
