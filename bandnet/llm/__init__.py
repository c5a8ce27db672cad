"""Operators for preparing the training data of language models, each as Spark jobs over document tables."""
