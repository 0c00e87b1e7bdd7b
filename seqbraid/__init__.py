"""seqbraid: sequence-graph and interval analytics as Spark DataFrame operators."""
