"""newsloom: Spark-first recommendation analytics over click logs and articles."""
