"""DataFrame-to-DataFrame operators, meant for ``DataFrame.transform``."""
