"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from .decontamination import op6_decontamination
from .katz_lm import op4_katz_lm
from .language_id import op5_language_id
from .merkle_manifest import ORACLE as MANIFEST_SQL
from .merkle_manifest import op13_merkle_manifest
from .multiset_hash import op11_multiset_hash
from .ngram_join import ORACLE as JOIN_SQL
from .ngram_join import op8_ngram_join
from .quality_model import op7_quality_model
from .quality_rules import op10_quality_rules
from .secret_scan import op9_secret_scan
from .sentencepiece_codec import op2_sentencepiece
from .toxicity import op3_toxicity
from .url_filter import ORACLE as URL_SQL
from .url_filter import op1_url_filter
from .word_runs import op12_word_runs

QUERIES = {f.__name__: f for f in (op1_url_filter, op2_sentencepiece, op3_toxicity, op4_katz_lm, op5_language_id, op6_decontamination, op7_quality_model, op8_ngram_join, op9_secret_scan, op10_quality_rules, op11_multiset_hash, op12_word_runs, op13_merkle_manifest)}
ORACLE_SQL = {"op1_url_filter": URL_SQL, "op8_ngram_join": JOIN_SQL, "op13_merkle_manifest": MANIFEST_SQL}
