"""caseloom: DataFrame operators for case-assistance data on Apache Spark."""
