"""turnframe: interval and event-stream analytics on Spark DataFrames."""
