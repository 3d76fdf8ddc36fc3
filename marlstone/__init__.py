"""Spark-native analytics over reinforcement-learning rollouts and training text."""
