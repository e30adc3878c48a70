"""millrace: retail reports and corpus preparation as declarative Spark jobs."""
