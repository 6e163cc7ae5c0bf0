"""Log analytics and root-cause analysis as Spark DataFrame programs."""
