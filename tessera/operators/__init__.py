"""Index scans, fusion, predicates, metadata and reports over DataFrames."""
