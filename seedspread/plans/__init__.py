"""Named queries over the test tables (``catalog``) and their SQL oracles (``oracle``)."""
