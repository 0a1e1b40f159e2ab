"""A PySpark-native analytics engine for shop event and change-data streams."""
