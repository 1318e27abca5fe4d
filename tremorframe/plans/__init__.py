"""End-to-end jobs: observation preparation, relocation and sampling, training pairs."""
