"""veilgrid: annotation, anonymisation and corpus analytics on Spark DataFrames."""
