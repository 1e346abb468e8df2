"""partweave: parts-list analytics on PySpark."""
