"""Training-data operators: tokenising, packing, scrubbing, filtering and near-duplicate removal."""
