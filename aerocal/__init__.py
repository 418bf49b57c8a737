"""Sensor time-series cleaning, alignment and calibration on Spark DataFrames."""
