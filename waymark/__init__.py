"""waymark: Spark-first analytics for events tied to places and time."""
