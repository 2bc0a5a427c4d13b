"""End-to-end plans: the request flows and the stand-in mapping used to run
every operator on the TPC-H-style test tables."""
