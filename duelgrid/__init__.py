"""duelgrid: analytics for entities that meet in dated, pairwise bouts, as Spark jobs."""
