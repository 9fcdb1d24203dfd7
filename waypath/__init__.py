"""Trajectory, point-cloud and satellite-navigation analytics on Spark."""
