"""Cohort curation, quality control and longitudinal analytics on Spark DataFrames."""
