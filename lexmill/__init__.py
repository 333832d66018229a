"""Text-quality analytics on Spark: documents in, findings and measures out."""
