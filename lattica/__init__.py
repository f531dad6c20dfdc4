"""lattica: a PySpark-native engine for catalogue, grid, chart and timeline queries."""
