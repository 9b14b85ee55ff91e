"""flowlens: Spark-first operators for labelled, time-ordered flow data."""
