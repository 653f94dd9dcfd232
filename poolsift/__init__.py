"""Sample selection, labelling state and experiment-log analytics as Spark DataFrame operators."""
