"""tidewatch: alert-stream analytics on Spark DataFrames."""
