"""DataFrame operators for cataloguing large file corpora and the tables derived from them."""
