"""Sources: file reads, dispatch, profiles, fingerprints, and views over the test tables."""
