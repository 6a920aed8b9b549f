"""Defaults of the operators. Results depend on them."""

# chunking
CHUNK_MIN_TOKENS = 100
CHUNK_MAX_TOKENS = 1000
OVERLAP_MIN_TOKENS = 10
OVERLAP_MAX_TOKENS = 250
OVERLAP_MAX_PARTS = 3
BOUNDARY_THRESHOLD = 0.5

# embedding
EMBEDDING_DIM = 1024

# retrieval cascade
RETRIEVER_TOP_K = 50
COARSE_TOP_K = 20
FINAL_TOP_K = 5

# fusion
RRF_K = 60
RRF_ALPHA = 0.3
RRF_BETA = 0.2
BASE_WEIGHTS = {
    "entity": {"dense": 0.3, "sparse": 0.5, "graph": 0.2},
    "semantic": {"dense": 0.6, "sparse": 0.2, "graph": 0.2},
    "mixed": {"dense": 0.4, "sparse": 0.3, "graph": 0.3},
}

# BM25
BM25_K1 = 1.2
BM25_B = 0.75
HEADING_BOOST = 3.0

# confidence
CONFIDENCE_THRESHOLD = 0.6

# storage tiers
HOT_DAYS = 30
WARM_DAYS = 90
PROMOTE_PER_DAY = 10
DEMOTE_PER_DAY = 1

# upload
SUPPORTED_TYPES = ["pdf", "docx", "doc", "txt", "html", "md"]
MAX_FILE_BYTES = 100 * 1024 * 1024

# truncation lengths, in characters
GRAPH_PREVIEW_CHARS = 500
EXCERPT_CHARS = 300
PREVIEW_CHARS = 200
RERANK_CHARS = 1000

# time to live, in seconds
QUERY_TTL = 300
VECTOR_TTL = 1800
SESSION_TTL = 3600

# histogram bounds
QUERY_LATENCY_BUCKETS = [50, 100, 200, 300, 500, 1000, 2000, 5000]
RETRIEVER_LATENCY_BUCKETS = [10, 25, 50, 100, 200, 500]
GENERATION_LATENCY_BUCKETS = [100, 500, 1000, 2000, 5000, 10000]
REQUEST_SECONDS_BUCKETS = [0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]

TASK_MAX_RETRIES = 3

STATUSES = ["pending", "processing", "indexing", "completed", "failed", "deleted"]
