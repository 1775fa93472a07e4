"""folioloom: Spark-native analytics over collections of scanned book pages."""
