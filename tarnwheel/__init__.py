"""Analytics operators over tables and streams, written as Spark jobs."""
