"""Reading and writing corpora, manifests, prediction tables and reports."""
