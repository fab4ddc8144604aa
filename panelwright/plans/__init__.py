"""Model specifications, the logical plan of a fit."""
