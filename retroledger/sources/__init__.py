"""Change-log sources, catalogs and the tables derived for tests."""
