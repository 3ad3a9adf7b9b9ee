"""Analytics over vehicle diagnostic logs, written as Spark DataFrame programs."""
