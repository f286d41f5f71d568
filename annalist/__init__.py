"""Analytics over the histories that AI coding agents leave behind, as Spark jobs."""
