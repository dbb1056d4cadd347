"""echograph: a Spark-first engine for calibrated detection of text reuse."""
