"""Spark jobs for mass-spectrometry point clouds."""
