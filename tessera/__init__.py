"""Tessera: hybrid document retrieval and corpus analytics on DataFrames."""
