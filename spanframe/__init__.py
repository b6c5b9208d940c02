"""Time-span, token-stream and text-corpus analytics on Spark DataFrames."""
