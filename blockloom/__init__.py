"""blockloom: a PySpark-native engine for hash-linked block streams and versioned entities."""
