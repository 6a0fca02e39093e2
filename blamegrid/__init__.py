"""blamegrid: incident root-cause ranking and analytics as PySpark DataFrame jobs."""
