"""Readers and writers: dumps, images, features, indexes and pair batches."""
