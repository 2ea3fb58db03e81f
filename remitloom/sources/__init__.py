"""Where tables come from and how results are written."""
