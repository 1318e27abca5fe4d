"""Readers and writers: input tables, sample store, run checkpoints and run logs."""
