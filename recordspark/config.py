"""Named thresholds of the engine; every one is also a keyword argument where it is used."""

MIN_TEXT_LENGTH = 50
SPARSE_WORDS = 5
SPARSE_CONFIDENCE = 0.50
DENSE_RATIO = 0.80
MAX_DOC_ENTITIES = 200
TOP_NEIGHBOURS = 40
MIN_SHARED = 2
MAX_QUERY_CHARS = 200
MAX_LIKE_BYTES = 50
MAX_EXCLUSIONS = 80
MAX_POLICY_BYTES = 16 * 1024
CONFIDENCE_BANDS = (("under-0.50", 0.0, 0.5), ("0.50-0.69", 0.5, 0.7), ("0.70-0.89", 0.7, 0.9), ("0.90-plus", 0.9, 1.000001))
STOP_TERMS = ("or", "and", "the", "for", "with")
BM25_K1, BM25_B, BM25_FLOOR = 1.2, 0.75, 1e-6
