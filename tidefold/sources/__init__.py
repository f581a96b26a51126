"""Reading and writing: listings, journals, packs, the operation log of a server, encrypted records."""
