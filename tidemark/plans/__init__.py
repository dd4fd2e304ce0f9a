"""What to read and when: declarations, read plans, folds."""
