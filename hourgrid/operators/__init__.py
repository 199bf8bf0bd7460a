"""DataFrame-to-DataFrame operators over readings, dimensions and panels."""
