"""tessera: a document-catalogue analytics engine on PySpark DataFrames."""
