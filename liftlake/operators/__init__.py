"""DataFrame -> DataFrame operators over the training log."""
