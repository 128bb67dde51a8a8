"""Operators on meshes, graphs, rooted trees and annotations; every table is keyed by its object's id."""
