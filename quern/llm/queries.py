"""The training-data queries by name."""

from __future__ import annotations

from quern.llm.ann import op10_learned_partitions
from quern.llm.exact import OP13_SQL, op13_heavy_hitter_dedup
from quern.llm.fim import OP11_SQL, op11_marker_injection
from quern.llm.merkle import OP12_SQL, op12_merkle_supersteps
from quern.llm.near import op7_dart_minhash
from quern.llm.nndescent import op3_nn_descent
from quern.llm.packing import op1_packing
from quern.llm.paragraphs import op5_paragraph_minhash
from quern.llm.pii import op6_surrogates
from quern.llm.substring import op2_suffix_array
from quern.llm.toxicity import op4_classifier_chain
from quern.llm.unigram import op9_shared_viterbi
from quern.llm.warc import OP8_SQL, op8_revisits

QUERIES = {"op1_packing": op1_packing, "op2_suffix_array": op2_suffix_array, "op3_nn_descent": op3_nn_descent, "op4_classifier_chain": op4_classifier_chain, "op5_paragraph_minhash": op5_paragraph_minhash, "op6_surrogates": op6_surrogates, "op7_dart_minhash": op7_dart_minhash,
    "op8_revisits": op8_revisits, "op9_shared_viterbi": op9_shared_viterbi, "op10_learned_partitions": op10_learned_partitions,
    "op11_marker_injection": op11_marker_injection, "op12_merkle_supersteps": op12_merkle_supersteps, "op13_heavy_hitter_dedup": op13_heavy_hitter_dedup,
}
ORACLE_SQL: dict[str, str] = {"op8_revisits": OP8_SQL, "op11_marker_injection": OP11_SQL, "op12_merkle_supersteps": OP12_SQL, "op13_heavy_hitter_dedup": OP13_SQL}
