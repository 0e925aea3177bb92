"""beatloom: pulse-interval analytics as Spark DataFrame jobs."""
