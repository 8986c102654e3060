"""Maritime routes, polar water graphs and ice hazards as Spark DataFrame jobs."""
