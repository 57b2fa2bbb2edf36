"""tickforge: a PySpark-native engine for market-data analytics."""
