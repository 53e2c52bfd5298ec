"""Analytics over benchmark and evaluation records, written as Spark DataFrame jobs."""
