"""Analytics jobs over tables and streams, written against the Spark DataFrame API."""
