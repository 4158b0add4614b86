"""The queries of this subpackage and, where SQL can express them, the same in DuckDB's SQL."""

from . import fixity
from .chat import op2_chat_formatting
from .decontaminate import op10_decontamination
from .fixity import op9_fixity
from .lines import op8_line_dedup
from .minhash import op5_minhash
from .packing import op7_packing
from .quality import op6_quality_rules
from .secrets import op4_secret_scan
from .suffix_dedup import op1_suffix_dedup
from .toxicity import op3_toxicity

QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_chat_formatting, op3_toxicity, op4_secret_scan, op5_minhash, op6_quality_rules, op7_packing, op8_line_dedup, op9_fixity, op10_decontamination)}
ORACLES = {"op9_fixity": fixity.ORACLE_SQL}
