"""eventloom: event listings collected, verified, deduplicated and queried as Spark DataFrames."""
