"""Document evidence analytics as Spark plans."""
