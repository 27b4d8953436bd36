"""The registered queries of this package and their comparison SQL (only where SQL can express one)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from usageloom.llm.exactdedup import OP5_SQL, op5_exact_dedup
from usageloom.llm.jaccard import OP10_SQL, op10_ngram_jaccard_join
from usageloom.llm.langid import op9_language_id
from usageloom.llm.licenses import op3_license_scan
from usageloom.llm.linededup import OP4_SQL, op4_line_dedup
from usageloom.llm.merkle import OP12_SQL, op12_merkle_manifest
from usageloom.llm.mixing import op2_mix_sources
from usageloom.llm.neighbours import op7_nearest_neighbours
from usageloom.llm.packing import op8_best_fit_packing
from usageloom.llm.piececodec import op11_sentencepiece_codec
from usageloom.llm.prefixtrie import OP13_SQL, op13_prefix_trie
from usageloom.llm.quality import op6_quality_crf
from usageloom.llm.tokencount import op1_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_mix_sources,
        op3_license_scan,
        op4_line_dedup,
        op5_exact_dedup,
        op6_quality_crf,
        op7_nearest_neighbours,
        op8_best_fit_packing,
        op9_language_id,
        op10_ngram_jaccard_join,
        op11_sentencepiece_codec,
        op12_merkle_manifest,
        op13_prefix_trie,
    )
}
SQL: dict[str, str] = {
    "op4_line_dedup": OP4_SQL,
    "op5_exact_dedup": OP5_SQL,
    "op10_ngram_jaccard_join": OP10_SQL,
    "op12_merkle_manifest": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}
