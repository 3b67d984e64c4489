"""Memory-bank anomaly scoring and training-data operators as Spark DataFrame plans."""
