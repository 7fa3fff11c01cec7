"""panelforge: message-and-market analytics on Spark DataFrames."""
