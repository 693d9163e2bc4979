"""Timetable reachability and corpus processing on Spark DataFrames."""
