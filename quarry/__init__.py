"""quarry: Spark jobs that turn many source repositories into queryable tables."""
