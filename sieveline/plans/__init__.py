"""Whole runs: context-set construction, baseline, ablation, cost sweep, and the query catalog."""
