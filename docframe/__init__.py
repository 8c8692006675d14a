"""Analytics over collections of documents, as DataFrames."""
