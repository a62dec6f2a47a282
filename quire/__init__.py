"""quire: document-layout analytics and training-data operators on Spark DataFrames."""
