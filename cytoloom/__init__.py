"""Perturbation-response analytics on Spark: tables of measurements in, calibrated and ranked candidates out."""
