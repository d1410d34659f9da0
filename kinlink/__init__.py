"""Record linkage and the analytics around it, expressed as Spark plans."""
