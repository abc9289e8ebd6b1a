"""Scans: driver tables as points, boxes, images, trajectories and samples."""
