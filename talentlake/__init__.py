"""A Spark-first engine for corpora of résumés, job descriptions and text records."""
