"""Schema, segmented timelines and exact quantiles shared by every operator."""
