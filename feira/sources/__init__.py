"""Where the source tables come from and how reports are exchanged as text."""
