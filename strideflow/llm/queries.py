"""The corpus operators as queries over the given tables, and their SQL where SQL can say it."""

from .fingerprints import op7_fingerprints
from .languages import op5_language
from .mixing import OP8_SQL, op8_mixing
from .near_duplicates import op4_near_duplicates
from .packing import op3_packing
from .pii import op2_pii
from .search import OP6_SQL, op6_topk
from .secrets import op9_secrets
from .sharding import op1_sharding
from .toxicity import op10_toxicity

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_pii": op2_pii,
    "op3_packing": op3_packing,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_language": op5_language,
    "op6_topk": op6_topk,
    "op7_fingerprints": op7_fingerprints,
    "op8_mixing": op8_mixing,
    "op9_secrets": op9_secrets,
    "op10_toxicity": op10_toxicity,
}
SQL = {"op6_topk": OP6_SQL, "op8_mixing": OP8_SQL}
