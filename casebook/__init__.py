"""Case-log analytics on Spark: DataFrame operators for event logs, labels, features and model evaluation."""
