"""riskweave: a data-risk audit engine written as Spark DataFrame plans."""
