"""A PySpark-native query and data-processing engine for JSON documents."""
