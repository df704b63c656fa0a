"""ravelin: a Spark-native engine for typed datasets, metric cells, graphs and statistics."""
