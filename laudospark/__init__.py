"""Report-text analytics on Spark: DataFrame -> DataFrame operators built from native expressions."""

from .functions.classify import classify_exam, exam_label, exam_scores
from .functions.entities import extract_entities
from .functions.header import exam_date, normalize_date, patient_data, patient_token, split_header
from .functions.redact import pii_counts, pseudonymize, strip_pii
from .plans.pipeline import result_document, run_pipeline
from .session import build_session
from .sources.lexicon import builtin_lexicon, read_lexicon
from .sources.readers import read_case_bank, read_reports, read_state, read_uploads, read_vision_outputs
from .sources.writers import export_retrain_set, export_seed, export_tables, write_results

__all__ = [
    "build_session",
    "builtin_lexicon",
    "classify_exam",
    "exam_date",
    "exam_label",
    "exam_scores",
    "export_retrain_set",
    "export_seed",
    "export_tables",
    "extract_entities",
    "normalize_date",
    "patient_data",
    "patient_token",
    "pii_counts",
    "pseudonymize",
    "read_case_bank",
    "read_lexicon",
    "read_reports",
    "read_state",
    "read_uploads",
    "read_vision_outputs",
    "result_document",
    "run_pipeline",
    "split_header",
    "strip_pii",
    "write_results",
]
