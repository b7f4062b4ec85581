"""slopeworks: place-based hazard analytics and corpus preparation as Spark jobs."""
