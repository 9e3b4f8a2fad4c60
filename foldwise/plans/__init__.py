"""End-to-end jobs (OOF training, stacking, run views) and the query catalog."""
