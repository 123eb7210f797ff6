"""lontar: retrieval, evaluation, data quality and text analytics over semi-structured listings, on Spark."""
