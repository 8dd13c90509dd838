"""barloom: quantitative analytics on bars, news and text, written as Spark jobs."""
