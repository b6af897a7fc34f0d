"""tracelake: Spark-native operators for block-structured logs, run results and expression graphs."""
