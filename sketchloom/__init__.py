"""Mergeable one-pass sketches for Spark DataFrames.

Three families, each held as an ordinary struct column that can be stored, shuffled, merged and queried:
summary statistics (:mod:`sketchloom.operators.stats`), t-digests (:mod:`sketchloom.operators.tdigest`) and
Space-Saving summaries (:mod:`sketchloom.operators.spacesaving`).
"""

import pyspark

__version__ = "0.2.0"
__engine_version__ = pyspark.__version__


def engine_version() -> str:
    """Version of the engine that the sketches run on."""
    return pyspark.__version__
