"""burrow: nested-path analytics on Spark DataFrames."""
