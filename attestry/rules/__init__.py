"""Rules that compare a claim with a piece of evidence, as data and Columns."""
