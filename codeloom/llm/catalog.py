"""The queries of this subpackage and their SQL."""

from . import chat_format, conversation_repair, exact_dedup, knn, language_id, line_dedup, mixing, packing, periodic_runs, secret_scan, sharding, simhash, warc

QUERIES = {
    "op1_warc": warc.query,
    "op2_language_id": language_id.query,
    "op3_packing": packing.query,
    "op4_mixing": mixing.query,
    "op5_line_dedup": line_dedup.query,
    "op6_chat_format": chat_format.query,
    "op7_simhash": simhash.query,
    "op8_knn": knn.query,
    "op9_exact_dedup": exact_dedup.query,
    "op10_secret_scan": secret_scan.query,
    "op11_conversation_repair": conversation_repair.query,
    "op12_sharding": sharding.query,
    "op13_periodic_runs": periodic_runs.query,
}
ORACLES = {
    "op1_warc": warc.ORACLE,
    "op4_mixing": mixing.ORACLE,
    "op6_chat_format": chat_format.ORACLE,
    "op8_knn": knn.ORACLE,
    "op9_exact_dedup": exact_dedup.ORACLE,
    "op10_secret_scan": secret_scan.ORACLE,
    "op11_conversation_repair": conversation_repair.ORACLE,
}
