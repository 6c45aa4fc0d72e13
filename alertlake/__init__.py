"""alertlake: a Spark-native engine for archives of short, late-arriving alert posts."""
