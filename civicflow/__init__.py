"""civicflow: batch data preparation for city records, written for Spark."""
