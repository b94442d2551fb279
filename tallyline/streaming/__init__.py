"""Feeds under watch and day buckets over streams."""
