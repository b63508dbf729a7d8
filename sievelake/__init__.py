"""Entity resolution and data fusion as Spark DataFrame plans."""
