"""Column builders: validators, masks, text normalisation."""
