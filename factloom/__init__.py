"""Multi-source fact graphs and text corpora on PySpark."""
