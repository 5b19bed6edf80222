"""plumbline: Spark-native checking and analysis of page reconstructions at scale."""
