"""Log normalisation and collection-fleet analytics as PySpark DataFrame jobs."""
