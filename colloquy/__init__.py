"""colloquy: transcript analytics on Spark DataFrames."""
