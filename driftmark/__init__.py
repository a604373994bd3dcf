"""Track, window and behaviour analytics as Spark DataFrame functions."""
