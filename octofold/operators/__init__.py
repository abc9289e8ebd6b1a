"""Relational operators on voxel maps, images, trajectories and statistics."""
