"""quantloom: a PySpark-native engine for cross-sectional risk and return analysis."""
