"""A PySpark-native engine for dense time series that come apart losslessly."""
