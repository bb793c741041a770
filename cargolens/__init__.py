"""Supply-chain analytics as Spark DataFrame jobs."""
