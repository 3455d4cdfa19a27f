"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from .decontaminate import OP4_SQL, op4_decontaminate
from .hard_negatives import OP13_SQL, op13_hard_negatives
from .jaccard_join import OP9_SQL, op9_jaccard_join
from .language import op5_language_id
from .line_dedup import op2_line_dedup
from .media import op8_media_columns
from .quality_rules import OP11_SQL, op11_quality_rules
from .secrets_ledger import op1_secret_scan
from .substring_dedup import OP10_SQL, op10_substring_dedup
from .suffix_dedup import OP7_SQL, op7_suffix_dedup
from .token_counts import op6_token_counts
from .trie_bpe import op3_bpe_roundtrip
from .vector_codes import OP12_SQL, op12_vector_codes

QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_line_dedup, op3_bpe_roundtrip, op4_decontaminate, op5_language_id, op6_token_counts, op7_suffix_dedup, op8_media_columns, op9_jaccard_join, op10_substring_dedup, op11_quality_rules, op12_vector_codes, op13_hard_negatives)}
ORACLE_SQL = {"op4_decontaminate": OP4_SQL, "op7_suffix_dedup": OP7_SQL, "op9_jaccard_join": OP9_SQL, "op10_substring_dedup": OP10_SQL, "op11_quality_rules": OP11_SQL, "op12_vector_codes": OP12_SQL, "op13_hard_negatives": OP13_SQL}
