"""quire: a Spark-first engine whose rows are documents."""
