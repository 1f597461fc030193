"""The queries of this subpackage, for the driver's entry module."""

from . import (bloomrank, conversations, decontaminate, langid, linkgraph, lm, maglev, packing, passages, pivots,
               pseudonyms, quality_cnn, superminhash)

QUERIES = {
    "op1_pivot_index": pivots.op1_pivot_index,
    "op2_quality_cnn": quality_cnn.op2_quality_cnn,
    "op3_maglev": maglev.op3_maglev,
    "op4_language_id": langid.op4_language_id,
    "op5_pseudonyms": pseudonyms.op5_pseudonyms,
    "op6_link_graph": linkgraph.op6_link_graph,
    "op7_superminhash": superminhash.op7_superminhash,
    "op8_packing": packing.op8_packing,
    "op9_compact_windows": passages.op9_compact_windows,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_bit_sliced_search": bloomrank.op11_bit_sliced_search,
    "op12_turn_repair": conversations.op12_turn_repair,
    "op13_elias_fano_lm": lm.op13_elias_fano_lm,
}

SQL = {
    "op3_maglev": maglev.SQL,
    "op1_pivot_index": pivots.SQL,
    "op7_superminhash": superminhash.SQL,
    "op10_decontaminate": decontaminate.SQL,
    "op11_bit_sliced_search": bloomrank.SQL,
}
