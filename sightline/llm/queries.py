"""All queries of this subpackage."""

from sightline.llm import (  # noqa: F401
    fill_middle, forest, hilbert, langid, line_dedup, maxscore, mixing, ns_kmeans, packing, parity_join,
    sentence_pieces, substring, warc,
)
from sightline.llm.registry import ORACLES, QUERIES  # noqa: F401
