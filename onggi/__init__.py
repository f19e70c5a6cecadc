"""onggi: a Spark-native engine for building and measuring noisy Korean language-model data."""
