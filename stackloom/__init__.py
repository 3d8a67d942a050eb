"""stackloom: imaging-metadata analytics as plain DataFrame-to-DataFrame functions on Spark."""
