"""A PySpark-native engine for audio-fingerprint recognition, its catalogue, and training-data preparation."""
