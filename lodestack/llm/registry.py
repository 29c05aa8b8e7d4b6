"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .chat_format import op7_role_repair
from .decontam import op1_decontaminate
from .divergence import OP12_SQL, op12_divergence_audit
from .fingerprint import op9_piecewise_hash
from .lm_score import op10_pseudo_likelihood
from .mixing import OP3_SQL, op3_pfair_mix
from .near_dedup import OP8_SQL, op8_bbit_minhash
from .quality import op2_byte_cnn
from .secrets import op5_secret_spans
from .substrings import OP13_SQL, op13_super_kmers
from .url_filter import OP4_SQL, op4_url_verdicts
from .vector_codes import OP11_SQL, op11_exponion_codes
from .warc import OP6_SQL, op6_warc_round_trip

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_byte_cnn": op2_byte_cnn,
    "op3_pfair_mix": op3_pfair_mix,
    "op4_url_verdicts": op4_url_verdicts,
    "op5_secret_spans": op5_secret_spans,
    "op6_warc_round_trip": op6_warc_round_trip,
    "op7_role_repair": op7_role_repair,
    "op8_bbit_minhash": op8_bbit_minhash,
    "op9_piecewise_hash": op9_piecewise_hash,
    "op10_pseudo_likelihood": op10_pseudo_likelihood,
    "op11_exponion_codes": op11_exponion_codes,
    "op12_divergence_audit": op12_divergence_audit,
    "op13_super_kmers": op13_super_kmers,
}
ORACLE = {
    "op3_pfair_mix": OP3_SQL,
    "op4_url_verdicts": OP4_SQL,
    "op6_warc_round_trip": OP6_SQL,
    "op8_bbit_minhash": OP8_SQL,
    "op11_exponion_codes": OP11_SQL,
    "op12_divergence_audit": OP12_SQL,
    "op13_super_kmers": OP13_SQL,
}
