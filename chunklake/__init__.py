"""chunklake: Spark-native analytics over content-addressed storage metadata."""
