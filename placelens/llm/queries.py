"""All registered queries of this subpackage."""

from placelens.llm import chat, filter_audit, fingerprints, jaccard_join, knn_join, mixing, packing, quality_rules, secrets, spelling, suffix_dedup, toxicity, warc  # noqa: F401
from placelens.llm.registry import ORACLES, QUERIES  # noqa: F401
