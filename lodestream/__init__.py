"""lodestream: online-learning, bandit analytics and corpus preparation on Spark."""
