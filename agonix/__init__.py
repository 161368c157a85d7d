"""Contest analytics as Spark jobs: DataFrame in, DataFrame out."""
