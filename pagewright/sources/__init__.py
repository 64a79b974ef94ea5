"""Readers of image folders, archives and logs."""
