"""roadspark: a PySpark-native engine for road-network sharding and routing."""
