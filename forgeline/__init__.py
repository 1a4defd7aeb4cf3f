"""forgeline: code-repository analytics and corpus preparation as Spark jobs."""
