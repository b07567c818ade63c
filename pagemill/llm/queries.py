"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pagemill.llm.centroids import OP11_SQL, op11_centroid_clustering
from pagemill.llm.counts import OP6_SQL, op6_token_rollup
from pagemill.llm.embeddings import OP4_SQL, op4_embedding_near_dedup
from pagemill.llm.language import op9_language_id
from pagemill.llm.licenses import op5_license_scan
from pagemill.llm.minhash import OP7_SQL, op7_minhash_near_dedup
from pagemill.llm.mixing import OP3_SQL, op3_mix_sources
from pagemill.llm.packing import op2_best_fit_packing
from pagemill.llm.quality import op8_quality_rules
from pagemill.llm.secrets import OP12_SQL, op12_secret_scan
from pagemill.llm.substrings import OP10_SQL, op10_substring_dedup
from pagemill.llm.urls import OP1_SQL, op1_url_filters
from pagemill.llm.whitening import op13_embedding_whitening

QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_mix_sources": op3_mix_sources,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_token_rollup": op6_token_rollup,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_language_id": op9_language_id,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_secret_scan": op12_secret_scan,
    "op13_embedding_whitening": op13_embedding_whitening,
}

ORACLES = {
    "op1_url_filters": OP1_SQL,
    "op3_mix_sources": OP3_SQL,
    "op4_embedding_near_dedup": OP4_SQL,
    "op6_token_rollup": OP6_SQL,
    "op7_minhash_near_dedup": OP7_SQL,
    "op10_substring_dedup": OP10_SQL,
    "op11_centroid_clustering": OP11_SQL,
    "op12_secret_scan": OP12_SQL,
}
