"""tidemark: ranked retrieval, curation and upkeep of long-lived text records on Spark DataFrames."""
