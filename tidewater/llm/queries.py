"""The operators' queries by name."""

from __future__ import annotations

from tidewater.llm.collocations import op13_collocations
from tidewater.llm.convnet import op4_convnet
from tidewater.llm.hilbert import op1_hilbert
from tidewater.llm.language import op9_language
from tidewater.llm.lines import op10_lines
from tidewater.llm.packing import op8_packing
from tidewater.llm.pieces import op2_pieces
from tidewater.llm.prefix_trie import op12_trie
from tidewater.llm.records import op5_records
from tidewater.llm.rules import op7_rules
from tidewater.llm.secret_scan import op11_secrets
from tidewater.llm.simhash import op3_simhash
from tidewater.llm.winnow import op6_winnow

QUERIES = {f.__name__: f for f in (op1_hilbert, op2_pieces, op3_simhash, op4_convnet, op5_records, op6_winnow,
                                   op7_rules, op8_packing, op9_language, op10_lines, op11_secrets,
                                   op12_trie, op13_collocations)}
# None of these can be said in DuckDB's SQL (no CRC-32, XXH64, tokenizers or trained models): see tests/llm.
STATEMENTS: dict[str, str] = {}
