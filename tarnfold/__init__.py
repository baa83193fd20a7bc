"""tarnfold: a Spark-first engine for reasoning-rollout and training-data tables."""

__version__ = "0.1.0"
