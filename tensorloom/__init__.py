"""Error-bounded tensor compression analytics on Spark."""
