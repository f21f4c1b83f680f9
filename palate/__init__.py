"""Personalised-recommendation analytics on Spark: eligibility, taste, population models, ranking, evaluation."""
