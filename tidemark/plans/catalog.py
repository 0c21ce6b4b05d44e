"""Queries over the provided tables, one per operator, with equal SQL."""

from __future__ import annotations

from . import catalog_align, catalog_files, catalog_names, catalog_pairs, catalog_rows, catalog_store, catalog_tracks, catalog_votes

QUERIES = {**catalog_align.QUERIES, **catalog_pairs.QUERIES, **catalog_names.QUERIES, **catalog_files.QUERIES, **catalog_rows.QUERIES, **catalog_store.QUERIES, **catalog_tracks.QUERIES, **catalog_votes.QUERIES}
SQL = {**catalog_align.SQL, **catalog_pairs.SQL, **catalog_names.SQL, **catalog_files.SQL, **catalog_rows.SQL, **catalog_store.SQL, **catalog_tracks.SQL, **catalog_votes.SQL}


def flagship(spark, sf_dir):
    """Fits and verdicts of all pairs of streams."""
    return catalog_align.fit_and_judge(spark, sf_dir)
