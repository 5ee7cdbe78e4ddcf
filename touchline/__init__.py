"""Match analytics expressed as Spark DataFrame operators."""
