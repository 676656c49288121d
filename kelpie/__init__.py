"""kelpie: analytics and corpus-processing operators expressed as Spark jobs."""
