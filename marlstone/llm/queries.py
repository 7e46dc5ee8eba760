"""Queries of this subpackage, by name, and the SQL of those that SQL can express."""

from .chat import op7_chat
from .decontaminate import op8_decontaminate
from .embeddings import op6_embeddings
from .language import op10_language
from .lm import op2_lm
from .oracles import ORACLE_SQL  # noqa: F401
from .packing import op1_pack
from .quality import op4_quality
from .secrets import op5_secrets
from .simhash import op9_simhash
from .substrings import op3_substrings

QUERIES = {f.__name__: f for f in (op1_pack, op2_lm, op3_substrings, op4_quality, op5_secrets, op6_embeddings, op7_chat, op8_decontaminate, op9_simhash, op10_language)}
