"""Training-data operators: similarity joins, packing, mixing, classifiers, models, extraction."""
