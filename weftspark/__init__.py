"""weftspark: DataFrame-first analytics for ordered event streams, text rows and vector geometry."""
