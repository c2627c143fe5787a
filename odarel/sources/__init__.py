"""Where tables come from and how results and metadata leave."""
