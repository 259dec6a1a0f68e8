"""skarn: source-code intelligence and corpus analytics as Spark DataFrame operators."""
