"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import collocations, embedding_dedup, hard_negatives, quality_rules
from .collocations import op11_collocations
from .embedding_dedup import op12_near_vectors
from .hard_negatives import op13_hard_negatives
from .language_id import op10_language
from .lattice_lm import op6_lattice_likelihood
from .mixing import op3_soft_mixing
from .ngram_join import op4_signature_trees
from .packing import op2_best_fit_packing
from .quality_mil import op5_attention_mil
from .quality_rules import op8_adaptive_rules
from .secrets import op1_secret_scan
from .toxicity import op7_boosted_trees
from .winnowing import op9_winnowing

QUERIES = {"op1_secret_scan": op1_secret_scan, "op2_best_fit_packing": op2_best_fit_packing, "op3_soft_mixing": op3_soft_mixing, "op4_signature_trees": op4_signature_trees, "op5_attention_mil": op5_attention_mil, "op6_lattice_likelihood": op6_lattice_likelihood, "op7_boosted_trees": op7_boosted_trees, "op8_adaptive_rules": op8_adaptive_rules, "op9_winnowing": op9_winnowing, "op10_language": op10_language, "op11_collocations": op11_collocations, "op12_near_vectors": op12_near_vectors, "op13_hard_negatives": op13_hard_negatives}
SQL: dict[str, str] = {"op8_adaptive_rules": quality_rules.SQL, "op11_collocations": collocations.SQL, "op12_near_vectors": embedding_dedup.SQL, "op13_hard_negatives": hard_negatives.SQL}
