"""PySpark-native engine for prompt-span importance analysis and corpus preparation."""
