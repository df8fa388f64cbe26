"""Readers: stored cubes, text lists and derived test cubes."""
