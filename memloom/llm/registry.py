"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from memloom.llm import bpe, dedup, embeddings, html, langid, lines, packing, phrases, quality, rules, sharding, trie, urls

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_dedup": dedup.op2_dedup,
    "op3_bpe": bpe.op3_bpe,
    "op4_embeddings": embeddings.op4_embeddings,
    "op5_sharding": sharding.op5_sharding,
    "op6_rules": rules.op6_rules,
    "op7_html": html.op7_html,
    "op8_urls": urls.op8_urls,
    "op9_quality": quality.op9_quality,
    "op10_langid": langid.op10_langid,
    "op11_trie": trie.op11_trie,
    "op12_lines": lines.op12_lines,
    "op13_phrases": phrases.op13_phrases,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {"op8_urls": urls.OP8_SQL, "op11_trie": trie.OP11_SQL, "op12_lines": lines.OP12_SQL, "op13_phrases": phrases.OP13_SQL}
