"""Supply-risk exposure on Spark: which suppliers does a disruption reach, how much, and why."""
