"""Spark-first analytics over large collections of résumé-style documents."""
