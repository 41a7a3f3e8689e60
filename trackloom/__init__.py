"""PySpark-native analytics for motion time series: DataFrame -> DataFrame operators."""
