"""quarrylens: a Spark-native engine for code and document retrieval and event-log analytics."""
