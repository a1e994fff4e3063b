"""Text, entity and knowledge-base analytics expressed as Spark plans."""
