"""Code and text retrieval analytics on Spark.

``functions`` are Column expressions, ``operators`` DataFrame transformations,
``sources`` listings, stores and driver tables, ``extract`` turns file texts into
rows, ``plans`` composes queries, ``streaming`` applies changes as they come.
"""
