"""Streams of annotations against fixed meshes."""
