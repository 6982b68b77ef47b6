"""Change-feed state, hybrid retrieval and grounded answers as Spark jobs."""
