"""Readers, writers, cache tables and tables derived from the driver inputs."""
