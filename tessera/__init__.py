"""A Spark-native engine for declared multi-source feeds: staging, resolution, history, survivorship and marts."""
