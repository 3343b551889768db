"""medloom: clinical-resource analytics written as Spark DataFrame plans."""
