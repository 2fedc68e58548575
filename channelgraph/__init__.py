"""Analytics over archives of messaging channels, written as Spark DataFrame jobs."""
