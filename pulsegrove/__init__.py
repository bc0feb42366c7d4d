"""pulsegrove: event-aligned time-series analytics and data preparation on PySpark DataFrames."""
