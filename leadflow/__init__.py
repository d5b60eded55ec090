"""leadflow: prospect research as Spark DataFrame jobs."""
