"""sparkloom: a PySpark-native analytics engine."""
