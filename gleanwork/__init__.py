"""A PySpark-native content-intelligence engine: DataFrame transforms over landed text, pages and feeds."""
