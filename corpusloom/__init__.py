"""Text-retrieval and corpus-maintenance operators expressed as Spark DataFrame jobs."""
