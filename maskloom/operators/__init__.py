"""DataFrame operators: detection, span resolution, vault, masking, unmasking, chunking, datasets, metrics."""
