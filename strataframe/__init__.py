"""Spark-native audit of embedding tables: variance, identity, direction, dictionaries, spectra, epochs."""
