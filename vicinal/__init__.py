"""vicinal: analytics for a place-discovery product, written as Spark jobs."""
