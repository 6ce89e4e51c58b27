"""Graph analytics over Spark DataFrames: labelled graph collections, kernels, persistence, walks and embeddings."""
