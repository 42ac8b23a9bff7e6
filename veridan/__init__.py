"""Point-in-time risk analytics on orders and returns, as Spark jobs."""
