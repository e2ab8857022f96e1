"""loanlens: lending-risk analytics expressed as Spark jobs."""
