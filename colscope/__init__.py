"""colscope - column profiling, data-quality findings and modelling advice as Spark DataFrames."""
