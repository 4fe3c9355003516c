"""Operators on cubes; every one takes and returns cubes and is lazy."""
