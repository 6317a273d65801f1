"""lodestrata: a PySpark-native engine for document retrieval, its evaluation, and corpus preparation."""
