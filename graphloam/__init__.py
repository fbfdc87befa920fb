"""Code-graph analytics and corpus preparation, expressed as Spark DataFrame operators."""
