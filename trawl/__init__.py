"""Spark-native retrieval, graph expansion, ranking and evaluation of ticket-to-code localisation."""
