"""Names of this package's queries, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, line_dedup, manifest, mixing, ngram_join, prefix_trie, topk
from . import queries as q


def queries() -> dict:
    return {name: f for name, f in vars(q).items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op2_topk": topk.ORACLE, "op3_perspectives": chat.ORACLE, "op4_source_mix": mixing.ORACLE, "op10_ngram_join": ngram_join.ORACLE, "op11_manifest": manifest.ORACLE, "op12_prefix_trie": prefix_trie.ORACLE, "op13_line_dedup": line_dedup.ORACLE}
