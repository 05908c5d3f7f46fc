"""A Spark-native engine for document-corpus retrieval, curation and evaluation."""
