"""matchlake: timed-event, tracking and text analytics as PySpark DataFrame operators."""
