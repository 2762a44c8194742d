"""Analytics over time-stamped measurements, written as Spark DataFrame jobs."""
