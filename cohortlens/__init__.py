"""Learner-cohort and engagement analytics on Spark DataFrames."""
