"""siltstone: DataFrame operators for analysing, cleaning and grouping text at scale on Apache Spark."""
