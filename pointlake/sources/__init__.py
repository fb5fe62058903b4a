"""Readers and writers of point-cloud, mesh and recording formats."""
