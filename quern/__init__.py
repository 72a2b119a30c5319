"""quern: annotation, provenance and evaluation queries as Spark plans."""
