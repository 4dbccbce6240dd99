"""folioquarry: queries and text analytics over document corpora, on Spark DataFrames."""
