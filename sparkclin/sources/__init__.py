"""Where resources come from and go to."""
