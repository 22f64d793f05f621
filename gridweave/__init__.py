"""gridweave: parameter grids, workplans and text extraction as Spark DataFrames."""
