"""Cross-submission document audit and corpus preparation on Spark."""
