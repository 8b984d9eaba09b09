"""Readers, writers and generated inputs."""
