"""The queries of this package by name, and SQL where it can express one."""

from __future__ import annotations

from . import lexical_search, negatives
from .decontamination import op2_decontamination
from .language_id import op6_language_id
from .lexical_search import op13_lexical_search
from .negatives import op11_hard_negatives
from .ngram_join import op9_ngram_join
from .packing import op5_packing
from .piece_encoding import op12_piece_encoding
from .quotation import op4_quotation_linking
from .recurrent_lm import op8_recurrent_lm
from .sharding import op10_sharding
from .simhash import op1_simhash
from .url_filter import op3_url_filter
from .warc_index import op7_warc_index

QUERIES = {f.__name__: f for f in (
    op1_simhash, op2_decontamination, op3_url_filter, op4_quotation_linking, op5_packing, op6_language_id, op7_warc_index,
    op8_recurrent_lm, op9_ngram_join, op10_sharding, op11_hard_negatives, op12_piece_encoding, op13_lexical_search)}

SQL: dict[str, str] = {"op11_hard_negatives": negatives.SQL, "op13_lexical_search": lexical_search.SQL}
