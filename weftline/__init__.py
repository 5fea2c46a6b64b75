"""DataFrame operators for naming, retrieval and split evaluation on Spark."""
