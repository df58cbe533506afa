"""DataFrame operators: search, fusion, targets, metrics, reports, pools, training."""
