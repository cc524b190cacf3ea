"""quern: a PySpark-native engine for curating labelled datasets and the time series derived from them."""
