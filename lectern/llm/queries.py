"""Queries of this subpackage by key, and the DuckDB SQL of those SQL can express."""

from __future__ import annotations

from .op10_lm import op10_lm
from .op11_toxicity import op11_toxicity
from .op12_fim import OP12_SQL, op12_fim
from .op13_variants import op13_variants
from .op1_secrets import op1_secrets
from .op2_byte_bpe import op2_byte_bpe
from .op3_binary import op3_binary
from .op4_chat import OP4_SQL, op4_chat
from .op5_quality import op5_quality
from .op6_suffix import op6_suffix
from .op7_minhash import op7_minhash
from .op8_packing import op8_packing
from .op9_simhash import op9_simhash

QUERIES = {f.__name__: f for f in (op1_secrets, op2_byte_bpe, op3_binary, op4_chat, op5_quality, op6_suffix, op7_minhash,
                                    op8_packing, op9_simhash, op10_lm, op11_toxicity, op12_fim, op13_variants)}

ORACLE: dict[str, str] = {"op4_chat": OP4_SQL, "op12_fim": OP12_SQL}
