"""Where inventories come from."""
