"""Session-event and claim analytics expressed as Spark plans."""
