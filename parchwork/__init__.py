"""Document analytics on PySpark: PDF files, text spans, layout and papers as DataFrames."""

__version__ = "0.1.0"
