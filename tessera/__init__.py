"""Array analytics on Spark: functions over integer coordinates, compiled to DataFrame plans."""
