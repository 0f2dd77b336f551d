"""folioflow: a Spark-first engine for corpus-scale document processing."""
