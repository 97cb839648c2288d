"""inkfold: a Spark-native document database and analytics engine."""
