"""The catalog's queries as SQL for an independent engine with RE2 regular expressions.

RE2 has neither look-ahead nor back-references: a terminator is caught by a group of its own and put
back, and same-separator dates are tested one separator at a time. Line ends in the derived texts are LF.
"""

from __future__ import annotations

import re

from ..rules import lexicon as L, patterns as R, prompts as PT
from ..sources.lexicon import compound_rows, term_rows
from .views import VIEWS

ORACLES: dict[str, str] = {}


def q(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("'", "''") + "'"


def has(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {q(pattern)})"


def group(column: str, pattern: str, i: int = 1) -> str:
    return f"regexp_extract({column}, {q(pattern)}, {i})"


def swap(column: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({column}, {q(pattern)}, {q(replacement)}, 'g')"


def ladder(low: str, steps: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {has(low, p)} THEN {q(v)}" for p, v in steps) + " END"


def re2(pattern: str) -> str:
    """A pattern without what only Java has: it finds the same, leftmost longest run of a class either way."""
    return re.sub(r"\(\?:\\G\|\(\?<![^)]*\)\)|\(\?<![^)]*\)", "", pattern).replace("]++", "]+")


def labels(low: str, rules: list[tuple[str, str]]) -> str:
    """Labels that occur, joined; NULL when none does."""
    parts = ", ".join(f"CASE WHEN {has(low, p)} THEN {q(v)} END" for p, v in rules)
    return f"nullif(concat_ws('|', {parts}), '')"


def number(column: str, pattern: str) -> str:
    return f"TRY_CAST(nullif({group(column, '(?i)' + pattern)}, '') AS INTEGER)"


def with_views(names: str, *steps: str) -> str:
    """WITH clause of derived tables and further steps, each computed once."""
    views = [f"{n} AS ({VIEWS[n][0]})" for n in names.split()]
    parts = [part.replace(" AS (", " AS MATERIALIZED (", 1) for part in [*views, *steps]]
    return "WITH " + ",\n".join(parts) + "\n"


# ------------------------------------------------------------------ shared steps

_MARKER = "(?i)^(?:" + "|".join(R.BODY_MARKERS) + ")"
SPLIT = (
    f"cut AS (SELECT *, string_split(text, chr(10)) AS ls, list_position(list_transform(string_split(text, chr(10)), "
    f"lambda l: regexp_matches(trim(l), {q(_MARKER)})), true) AS ix FROM reports)",
    "hb AS (SELECT report_id, filename, text, "
    "array_to_string(CASE WHEN ix > 0 THEN ls[1:ix-1] ELSE ls[1:5] END, chr(10)) AS header, "
    "CASE WHEN ix > 0 THEN array_to_string(ls[ix:], chr(10)) ELSE text END AS body FROM cut)",
)

_ENDS = r"(\s{3,}|\t|data:|idade:|nasc|rg:|cpf:|sexo:|\n|\r|\z)"
_LABELLED = r"(?i)(paciente\.{0,3}:|nome)[:\s]+([A-Za-zÀ-ÖØ-öø-ÿ ']+?)" + _ENDS
_NAME = r"(?i)(?:paciente\.{0,3}|nome)[:\s]+([A-Za-zÀ-ÖØ-öø-ÿ ']+?)" + _ENDS
_JOB = (
    r"(?i)(?:cargo|fun[çc][ãa]o|profiss[ãa]o|ocupa[çc][ãa]o)[:\s]+([A-Za-zÀ-ÖØ-öø-ÿ \/]+?)"
    r"(\s{3,}|\t|data:|idade:|sexo:|\n|\r|\z)"
)


def clean(column: str) -> str:
    return f"regexp_replace({column}, '^\\s+|\\s+$', '', 'g')"


def normalized(d: str) -> str:
    same = " OR ".join(has(d, rf"^\d{{1,4}}{s}\d{{1,2}}{s}\d{{2,4}}") for s in ("/", "-", r"\."))
    parts = r"^(\d{1,4})[-/.](\d{1,2})[-/.](\d{2,4})"
    a, b, y = (group(d, parts, i) for i in (1, 2, 3))
    two = "CASE WHEN length({0}) < 2 THEN lpad({0}, 2, '0') ELSE {0} END"
    year = f"CASE WHEN length({y}) = 4 THEN {y} ELSE '20' || {y} END"
    return (
        f"CASE WHEN NOT ({same}) THEN {d} WHEN length({a}) = 4 THEN {a} || '-' || {two.format(b)} || '-' || "
        f"{two.format(y)} ELSE {year} || '-' || {two.format(b)} || '-' || {two.format(a)} END"
    )


def first_date(where: str) -> str:
    tries = ", ".join(f"nullif({group(where, '(?i)' + p)}, '')" for p in R.EXAM_DATE_PATTERNS)
    return f"coalesce({tries}, '')"


_WHERE = "header || chr(10) || substr(body, 1, 800)"
_BIRTH = r"(?i)(?:data\s+(?:de\s+)?)?(?:nascimento|nasc\.?|d\.\s*n\.)[:\s]+\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{2,4}"
DATED = (
    f"d0 AS (SELECT *, {first_date(_WHERE)} AS raw_date FROM hb)",
    f"dated AS (SELECT *, {normalized('raw_date')} AS exam_date, 'pt-' || substr(CASE WHEN length(header) > 3 "
    "THEN sha256(header) ELSE sha256('report:' || CAST(report_id AS VARCHAR)) END, 1, 12) AS patient_token FROM d0)",
)

_RE2_RULES = {
    "rg": (r"(?i)(rg|registro\s+geral)[:\s]+([0-9xX.\-\s]+)(\n|\z)", r"\1: [RG OMITIDO]\3"),
    "plan": (
        r"(?i)(conv[eê]nio|plan[oa]|matr[ií]cula)[:\s]+([A-Za-zÀ-ÖØ-öø-ÿ\s\d]+)(\n|\z)",
        r"\1: [OMITIDO]\3",
    ),
}


def redacted(column: str, rule: tuple[str, str, str]) -> str:
    key, pattern, replacement = rule
    if key == "name":
        name = clean(group(column, _LABELLED, 2))
        stand_in = f"CASE WHEN {name} = '' THEN '[NOME PROTEGIDO]' ELSE '[Paciente_' || upper(substr(sha256({name}), 1, 6)) || ']' END"
        return f"regexp_replace({column}, {q(_LABELLED)}, '\\1 ' || {stand_in} || '\\3')"
    plain = ("(?i)" + pattern, replacement.replace("$1", r"\1"))
    pattern, replacement = _RE2_RULES.get(key, plain) if rule in R.PII_RULES else plain
    return swap(column, pattern, replacement)


def redaction_steps(source: str, column: str, rules: list[tuple[str, str, str]]) -> list[str]:
    """One derived table per rule; the last one is ``safe`` with the column ``safe_body``."""
    steps, previous, current = [], source, column
    for i, rule in enumerate(rules):
        name = "safe" if i == len(rules) - 1 else f"r{i}"
        steps.append(f"{name} AS (SELECT * EXCLUDE (safe_body), {redacted(current, rule)} AS safe_body FROM {previous})")
        previous, current = name, "safe_body"
    steps[0] = steps[0].replace(" EXCLUDE (safe_body)", "")
    return steps


def scores(low: str, compat: bool = True) -> dict[str, str]:
    flag = "" if compat else "(?i)"
    return {
        name: " + ".join(f"CAST({has(low, flag + p)} AS INTEGER)" for p in pats) for name, pats in R.EXAM_PATTERNS.items()
    }


def classified(source: str, text: str, compat: bool = True) -> list[str]:
    """Steps that add ``exam_type`` to a table: scores, then the first of the highest ones."""
    s = scores("low", compat)
    columns = ", ".join(f"{sql} AS s_{name}" for name, sql in s.items())
    best = "greatest(" + ", ".join(f"s_{n}" for n in s) + ")"
    choice = " ".join(f"WHEN s_{n} = {best} THEN {q(n)}" for n in s)
    return [
        f"lowered AS (SELECT *, lower({text}) AS low FROM {source})",
        f"scored AS (SELECT *, {columns} FROM lowered)",
        f"typed AS (SELECT * EXCLUDE ({', '.join('s_' + n for n in s)}), "
        f"CASE WHEN {best} = 0 THEN 'generico' {choice} END AS exam_type FROM scored)",
    ]


def label_of(column: str) -> str:
    cases = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in R.EXAM_LABELS.items())
    return f"CASE {column} {cases} ELSE {q(R.EXAM_LABELS[R.UNKNOWN_EXAM])} END"


def text_length(column: str) -> str:
    return f"length({clean(column)})"


GATED = (
    f"gated AS (SELECT *, {text_length('safe_body')} AS safe_chars, {text_length('safe_body')} < 80 AS low_confidence FROM safe)",
)
FINAL = (
    "final AS (SELECT * EXCLUDE (exam_type), CASE WHEN low_confidence THEN 'indefinido' ELSE exam_type END AS exam_type, "
    f"CASE WHEN low_confidence THEN {q(R.UNDEFINED_LABEL)} ELSE {label_of('exam_type')} END AS exam_label, "
    "CASE WHEN low_confidence THEN 'low_confidence' ELSE 'completed' END AS status, "
    "CASE WHEN low_confidence THEN substr(safe_body, 1, 300) ELSE substr(safe_body, 1, 300) || '...' END AS safe_text_snippet, "
    "NOT lower(filename) LIKE '%.pdf' AS was_raster_engine_used, length(text) AS raw_text_length, "
    "CASE WHEN low_confidence THEN 'Texto insuficiente: ' || CAST(safe_chars AS VARCHAR) || ' caracteres.' "
    "ELSE 'Processamento finalizado.' END AS message FROM typed)",
)
PIPELINE = (*SPLIT, *DATED, *redaction_steps("dated", "body", R.PII_RULES), *GATED, *classified("gated", "safe_body"), *FINAL)
TYPED = classified("reports", "text")

# Entities as SQL over a text column ``t`` and its lower-cased form ``low``


def entity(name: str, t: str, low: str) -> str:
    if name == "latencias":
        parts = []
        for w in R.BERA_WAVES:
            value = f"nullif({group(t, '(?i)' + R.BERA_WAVE.format(wave=w))}, '')"
            parts.append(f"'{w}=' || {value}")
        return f"concat_ws('|', {', '.join(parts)})"
    return {
        "decibeis": f"array_to_string(regexp_extract_all({t}, {q(R.DB_VALUES)}, 1), '|')",
        "tipo_perda": ladder(low, R.LOSS_TYPE),
        "ear_side": ladder(low, R.EAR_SIDE),
        "grau_perda": ladder(low, R.LOSS_DEGREE),
        "srt_db": number(t, R.SRT),
        "iprf_pct": number(t, R.IPRF),
        "sugestoes": labels(low, R.AUDIO_SUGGESTIONS),
        "limiar_db": number(t, R.BERA_THRESHOLD),
        "seios": labels(low, [(s, s) for s in R.SINUSES]),
        "ct_side": ladder(low, R.CT_SIDE),
        "ct_achados": labels(low, R.CT_FINDINGS),
        "mastoid_achados": labels(low, R.MASTOID_FINDINGS),
        "mastoid_side": ladder(low, R.MASTOID_SIDE),
        "neck_achados": labels(low, R.NECK_FINDINGS),
        "niveis": f"nullif(upper(array_to_string(regexp_extract_all({t}, {q(R.NECK_LEVELS)}, 1), '|')), '')",
    }[name]


def by_type(cases: dict[str, str]) -> str:
    return "CASE exam_type " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in cases.items()) + " END"


def findings(t: str, low: str) -> str:
    return by_type(
        {
            "tomografia": entity("ct_achados", t, low),
            "tomografia_mastoide": entity("mastoid_achados", t, low),
            "tomografia_pescoco": entity("neck_achados", t, low),
        }
    )


def sides(t: str, low: str) -> str:
    return by_type(
        {
            "audiometria": entity("ear_side", t, low),
            "tomografia": entity("ct_side", t, low),
            "tomografia_mastoide": entity("mastoid_side", t, low),
        }
    )


# ------------------------------------------------------------------ pipeline

O = ORACLES
REPORTS_PIPELINE = with_views("reports", *PIPELINE)
O["exams_by_month"] = REPORTS_PIPELINE + (
    "SELECT exam_type, substr(exam_date, 1, 7) AS exam_month, count(*) AS reports FROM final GROUP BY ALL"
)
O["report_results"] = REPORTS_PIPELINE + (
    "SELECT report_id, status, exam_date, patient_token, exam_type, exam_label, was_raster_engine_used, raw_text_length, "
    f"safe_text_snippet, low_confidence, {by_type({'audiometria': entity('decibeis', 'safe_body', 'low')})} AS decibeis, "
    f"{sides('safe_body', 'low')} AS lateralidade, {findings('safe_body', 'low')} AS achados FROM final"
)
O["distinct_tokens_by_month"] = REPORTS_PIPELINE + (
    "SELECT exam_type, exam_month, count(*) AS reports, count(DISTINCT patient_token) AS tokens, true AS near "
    "FROM (SELECT exam_type, substr(exam_date, 1, 7) AS exam_month, patient_token FROM final) GROUP BY ROLLUP (exam_type, exam_month)"
)
O["result_struct"] = REPORTS_PIPELINE + (
    "SELECT report_id, status, patient_token, CASE WHEN NOT low_confidence THEN exam_date END AS exam_date, exam_type, "
    "exam_label, CAST(raw_text_length AS VARCHAR) AS raw_text_length, safe_text_snippet, "
    "CASE WHEN low_confidence THEN 'true' END AS low_confidence, CAST(was_raster_engine_used AS VARCHAR) AS was_raster_engine_used, "
    f"{sides('safe_body', 'low')} AS lateralidade FROM final"
)
O["write_results"] = REPORTS_PIPELINE + (
    "SELECT report_id, exam_type, status, patient_token, CASE WHEN NOT low_confidence THEN exam_date END AS exam_date, "
    "CAST(raw_text_length AS VARCHAR) AS raw_text_length FROM final"
)
O["stream_reports"] = REPORTS_PIPELINE + (
    "SELECT exam_type, status, count(*) AS reports, count(*) AS documents FROM final GROUP BY ALL"
)
O["confidence_gate"] = REPORTS_PIPELINE + (
    "SELECT low_confidence, status, message, count(*) AS reports FROM final GROUP BY ALL"
)
O["distinct_tokens"] = REPORTS_PIPELINE + (
    "SELECT patient_token, count(*) AS reports, array_to_string(list_sort(list_distinct(list(exam_type))), '|') AS exam_types, "
    "min(nullif(exam_date, '')) AS first_exam, max(nullif(exam_date, '')) AS last_exam FROM final GROUP BY patient_token"
)
O["llm_validity_gate"] = with_views("reports llm_answers", *PIPELINE) + (
    "SELECT CASE WHEN low_confidence OR rejected THEN 'low_confidence' ELSE 'completed' END AS status, rejected, exam_type, "
    "count(*) AS reports, count(*) FILTER (WHERE NOT rejected) AS documents FROM (SELECT f.*, NOT f.low_confidence AND "
    "coalesce(TRY_CAST(answer AS JSON) ->> 'is_valid_exam' = 'false', false) AS rejected "
    "FROM final f LEFT JOIN llm_answers a ON f.report_id = a.report_id) GROUP BY ALL"
)
O["entities_json"] = REPORTS_PIPELINE + (
    f"SELECT report_id, exam_type, {sides('safe_body', 'low')} AS lateralidade, {findings('safe_body', 'low')} AS achados FROM final"
)

_DOCUMENTS = "reports AS (SELECT doc_id AS report_id, source || '.pdf' AS filename, text FROM documents)"
O["split_header_documents"] = with_views("", _DOCUMENTS, *SPLIT) + (
    "SELECT report_id AS doc_id, length(header) AS header_chars, length(body) AS body_chars FROM hb"
)
O["document_results"] = with_views("", _DOCUMENTS, *PIPELINE) + (
    "SELECT report_id AS doc_id, exam_type, status, raw_text_length FROM final"
)
_FIXED_DATES = (
    f"w AS (SELECT *, {swap(_WHERE, _BIRTH, '')} AS w FROM hb)",
    f"f0 AS (SELECT *, {first_date('w')} AS raw_date FROM w)",
    f"fixed AS (SELECT *, {normalized('raw_date')} AS exam_date FROM f0)",
)
O["report_results_fixed"] = with_views(
    "reports",
    *SPLIT,
    *_FIXED_DATES,
    *redaction_steps("fixed", "body", R.PII_RULES_FIXED),
    *GATED,
    *classified("gated", "safe_body", compat=False),
) + (
    "SELECT report_id, CASE WHEN low_confidence THEN 'indefinido' ELSE exam_type END AS exam_type, "
    "CAST(year(TRY_CAST(exam_date AS DATE)) AS INTEGER) AS exam_year FROM typed"
)

# ------------------------------------------------------------------ sources

O["scan_reports"] = with_views("reports") + (
    "SELECT report_id, filename, length(text) AS n_chars, sha256(text) AS text_hash FROM reports"
)
O["scan_reports_json"] = with_views("reports") + "SELECT report_id, filename, sha256(text) AS text_hash FROM reports"
O["scan_jobs"] = with_views("jobs") + "SELECT * REPLACE (CAST(created_at AS VARCHAR) AS created_at) FROM jobs"
O["scan_validations"] = with_views("validations") + (
    "SELECT * REPLACE (CAST(validated_at AS VARCHAR) AS validated_at) FROM validations"
)
_FENCED = "outputs AS (SELECT batch_id, unnest(json_keys(document)) AS filename, CAST(document AS JSON) AS doc FROM vision_outputs), answers AS (SELECT batch_id, filename, doc ->> filename AS answer FROM outputs)"
O["scan_reports_once"] = with_views("reports") + (
    "SELECT report_id, CASE WHEN report_id <= (SELECT median(report_id) FROM reports) THEN 1 ELSE 2 END AS run, filename, sha256(text) AS text_hash FROM reports"
)
O["purge_uploads"] = "SELECT lang, count(*) AS documents, 0 AS due_today FROM documents GROUP BY lang"
O["scan_llm_outputs"] = with_views("vision_outputs", _FENCED) + (
    "SELECT filename, length(answer) AS n_chars FROM answers"
)
O["scan_case_bank"] = with_views("case_bank") + (
    "SELECT document ->> '$.id' AS id, document ->> '$.filename' AS filename, "
    "document ->> '$.clinical_data_anonymized.idade' AS idade, "
    "document ->> '$.clinical_data_anonymized.parecer_audiologico' AS parecer_audiologico, "
    "document ->> '$.clinical_data_anonymized.valores_exame.LRF_OD' AS lrf_od FROM case_bank"
)

# ------------------------------------------------------------------ gates

O["route_by_extension"] = with_views("reports") + "SELECT report_id, lower(filename) LIKE '%.pdf' AS is_pdf FROM reports"
O["native_text_gate"] = with_views("reports") + (
    "SELECT report_id, NOT ok AS is_raster, CASE WHEN ok THEN length(text) ELSE 0 END AS n_chars FROM (SELECT *, "
    f"lower(filename) LIKE '%.pdf' AND {text_length('text')} >= 50 AS ok FROM reports)"
)
O["best_candidate_text"] = with_views("ocr_candidates") + (
    "SELECT report_id, text, strategy FROM (SELECT report_id, trim(text) AS text, strategy, row_number() OVER "
    "(PARTITION BY report_id ORDER BY length(trim(text)) DESC, ord) AS rn FROM ocr_candidates) WHERE rn = 1"
)
_PAGES = "SELECT report_id, coalesce(string_agg({piece}, '' ORDER BY page, text), '') AS text FROM report_pages GROUP BY report_id"
O["concat_pages"] = with_views("report_pages") + _PAGES.format(piece="CASE WHEN text <> '' THEN text || chr(10) ELSE '' END")
O["concat_all_pages"] = with_views("report_pages") + _PAGES.format(piece="text || chr(10)")
O["text_snippet"] = with_views("reports", *SPLIT) + (
    f"SELECT report_id, CASE WHEN {text_length('body')} < 80 THEN substr(body, 1, 300) ELSE substr(body, 1, 300) || '...' END AS snippet FROM hb"
)
O["retention_filter"] = with_views("uploaded_files") + (
    "SELECT path, CAST(modified_at AS VARCHAR) AS modified_at FROM uploaded_files "
    "WHERE modified_at < TIMESTAMP '2026-01-15 00:00:00' - INTERVAL 7 DAY"
)

# ------------------------------------------------------------------ header

HEADERS = with_views("reports", *SPLIT)
O["split_header"] = HEADERS + "SELECT report_id, header, body FROM hb"
O["exam_date"] = with_views("reports", *SPLIT, *DATED) + "SELECT report_id, exam_date FROM dated"
O["exam_date_fixed"] = with_views("reports", *SPLIT, *_FIXED_DATES) + (
    "SELECT report_id, exam_date, CAST(TRY_CAST(exam_date AS DATE) AS VARCHAR) AS exam_day FROM fixed"
)
O["normalize_date"] = with_views("raw_dates") + f"SELECT report_id, {normalized('raw')} AS exam_date FROM raw_dates"
O["patient_token"] = with_views("reports", *SPLIT, *DATED) + "SELECT report_id, patient_token FROM dated"

_BIRTH_DATE = group("header", "(?i)" + R.BIRTH_DATE_PATTERN)
_AGE = group("header", "(?i)" + R.AGE_PATTERN)
_SEX = f"lower(substr({group('header', '(?i)' + R.SEX_PATTERN)}, 1, 1))"
_PATIENT = {
    "nome": f"CASE WHEN length({clean(group('header', _NAME))}) BETWEEN 3 AND 79 AND contains({clean(group('header', _NAME))}, ' ') "
    f"THEN {clean(group('header', _NAME))} ELSE '' END",
    "data_nascimento": normalized(_BIRTH_DATE),
    "idade": f"CASE WHEN {_AGE} <> '' THEN {_AGE} || ' anos' ELSE '' END",
    "sexo": f"CASE {_SEX} WHEN 'm' THEN 'Masculino' WHEN 'f' THEN 'Feminino' ELSE '' END",
    "cargo_funcao": clean(group("header", _JOB)),
}
for _key, _field in zip(["patient_name", "birth_date", "age", "sex", "occupation"], _PATIENT):
    O[_key] = HEADERS + f"SELECT report_id, {_PATIENT[_field]} AS {_field} FROM hb"
O["patient_data"] = HEADERS + "SELECT report_id, " + ", ".join(f"{v} AS {k}" for k, v in _PATIENT.items()) + " FROM hb"

# ------------------------------------------------------------------ redaction

for _rule in R.PII_RULES:
    _key = "pseudonymize_name" if _rule[0] == "name" else f"redact_{_rule[0]}"
    O[_key] = with_views("reports") + f"SELECT report_id, {redacted('text', _rule)} AS safe_text FROM reports"
O["strip_pii"] = with_views("reports", *redaction_steps("reports", "text", R.PII_RULES)) + (
    "SELECT report_id, safe_body AS safe_text FROM safe"
)


O["strip_pii_fixed"] = with_views("reports", *redaction_steps("reports", "text", R.PII_RULES_FIXED)) + (
    "SELECT report_id, safe_body AS safe_text FROM safe"
)


def _count(column: str, pattern: str) -> str:
    return f"CAST(sum(length(regexp_extract_all({column}, {q(pattern)}))) AS BIGINT)"


_COUNTED = {"name": _LABELLED} | {k: v[0] for k, v in _RE2_RULES.items()}
O["pii_counts"] = with_views("reports") + (
    "SELECT lower(filename) LIKE '%.pdf' AS is_pdf, "
    + ", ".join(f"{_count('text', _COUNTED.get(k, '(?i)' + p))} AS n_{k}" for k, p, _ in R.PII_RULES)
    + " FROM reports GROUP BY 1"
)
O["pii_counts_documents"] = (
    "SELECT source, "
    + ", ".join(f"{_count('text', '(?i)' + re2(p))} AS n_{k}" for k, p, _ in R.GENERIC_PII_RULES)
    + " FROM documents GROUP BY source"
)
_generic = "text"
for _k, _p, _r in R.GENERIC_PII_RULES:
    _generic = swap(_generic, "(?i)" + re2(_p), _r)
O["strip_pii_documents"] = f"SELECT doc_id, sha256({_generic}) AS safe_hash FROM documents"

# ------------------------------------------------------------------ classification

_S = scores("lower(text)")
O["exam_scores"] = with_views("reports") + (
    "SELECT report_id, concat_ws('|', " + ", ".join(f"'{n}=' || CAST({s} AS VARCHAR)" for n, s in _S.items()) + ") AS scores FROM reports"
)
TYPED_REPORTS = with_views("reports", *TYPED)
O["classify_exam"] = TYPED_REPORTS + "SELECT report_id, exam_type FROM typed"
O["classify_exam_fixed"] = with_views("reports", *classified("reports", "text", compat=False)) + "SELECT report_id, exam_type FROM typed"
O["classify_documents"] = with_views("", *classified("documents", "text")) + (
    " SELECT lang, exam_type, count(*) AS documents FROM typed GROUP BY ALL"
)
O["exam_label"] = with_views("job_events") + f"SELECT seq, exam_type, {label_of('exam_type')} AS exam_label FROM job_events"
_EXPECTED = (
    "CASE WHEN report_id % 17 = 0 THEN 'generico' ELSE ['audiometria', 'bera', 'tomografia', 'tomografia_mastoide', "
    "'tomografia_pescoco', 'polissonografia', 'videolaringoscopia', 'endoscopia_nasal', 'generico'][CAST(report_id % 9 + 1 AS INTEGER)] END"
)
O["classification_eval"] = TYPED_REPORTS + f"SELECT {_EXPECTED} AS expected, exam_type, count(*) AS reports FROM typed GROUP BY ALL"
O["classification_accuracy"] = TYPED_REPORTS + (
    f"SELECT count(*) AS reports, count(*) FILTER (WHERE {_EXPECTED} = exam_type) AS hits, "
    f"count(*) FILTER (WHERE {_EXPECTED} = exam_type) / count(*) AS accuracy FROM typed"
)

# ------------------------------------------------------------------ entities

_SINGLE = {
    "audio_db_values": ("decibeis", "decibeis"),
    "audio_loss_type": ("tipo_perda", "tipo_perda"),
    "audio_laterality": ("lateralidade", "ear_side"),
    "audio_degree": ("grau_perda", "grau_perda"),
    "audio_srt": ("srt_db", "srt_db"),
    "audio_iprf": ("iprf_pct", "iprf_pct"),
    "audio_suggestions": ("sugestoes", "sugestoes"),
    "bera_latencies": ("latencias", "latencias"),
    "bera_threshold": ("limiar_db", "limiar_db"),
    "ct_sinuses": ("seios", "seios"),
    "ct_laterality": ("lateralidade", "ct_side"),
    "ct_findings": ("achados", "ct_achados"),
    "mastoid_findings": ("achados", "mastoid_achados"),
    "mastoid_laterality": ("lateralidade", "mastoid_side"),
    "neck_findings": ("achados", "neck_achados"),
    "neck_levels": ("niveis", "niveis"),
}
for _key, (_alias, _name) in _SINGLE.items():
    O[_key] = with_views("reports") + f"SELECT report_id, {entity(_name, 'text', 'lower(text)')} AS {_alias} FROM reports"


def only(exam_type: str, name: str) -> str:
    return by_type({exam_type: entity(name, "text", "low")})


O["extract_entities"] = TYPED_REPORTS + (
    "SELECT report_id, exam_type, "
    + ", ".join(
        f"{sql} AS {name}"
        for name, sql in {
            "decibeis_encontrados": only("audiometria", "decibeis"),
            "sugestoes_complementares": only("audiometria", "sugestoes"),
            "seios_afetados": only("tomografia", "seios"),
            "achados": findings("text", "low"),
            "niveis_cervicais": only("tomografia_pescoco", "niveis"),
            "tipo_perda": only("audiometria", "tipo_perda"),
            "lateralidade": sides("text", "low"),
            "grau_perda": only("audiometria", "grau_perda"),
            "srt_db": only("audiometria", "srt_db"),
            "iprf_pct": only("audiometria", "iprf_pct"),
            "limiar_eletrofisiologico_db": only("bera", "limiar_db"),
            "latencias_ms": only("bera", "latencias"),
        }.items()
    )
    + " FROM typed"
)

# ------------------------------------------------------------------ lexicon and prompts


def _values(rows: list[tuple], columns: str) -> str:
    def lit(v: object) -> str:
        if isinstance(v, list):
            return "[" + ", ".join(q(x) for x in v) + "]"
        return str(v) if isinstance(v, int) else q(str(v))

    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"(SELECT * FROM (VALUES {body}) v({columns}))"


KB = (
    f"terms AS {_values(term_rows(), 'exam_type, ord, termo, variantes, peso, significado')}",
    f"compounds AS {_values(compound_rows(), 'exam_type, ord, condicao, diagnostico, justificativa')}",
)
COUNTS = "counts AS (SELECT exam_type, count(*) AS reports FROM typed GROUP BY exam_type)"
O["kb_terms"] = with_views("reports", *TYPED, *KB, COUNTS) + (
    "SELECT exam_type, ord, termo, array_to_string(variantes, '|') AS variantes, peso, reports FROM terms LEFT JOIN counts USING (exam_type)"
)
O["scan_kb"] = O["kb_terms"].replace("LEFT JOIN counts", "JOIN counts")
O["kb_compounds"] = with_views("reports", *TYPED, *KB, COUNTS) + (
    "SELECT exam_type, ord, condicao, diagnostico, reports FROM compounds JOIN counts USING (exam_type)"
)
_HITS = (
    "hits AS (SELECT DISTINCT r.report_id, r.exam_type, t.termo, t.peso FROM typed r JOIN "
    "(SELECT exam_type, termo, peso, unnest(list_append(variantes, termo)) AS form FROM terms) t "
    "ON r.exam_type = t.exam_type AND contains(r.low, lower(t.form)))"
)
O["kb_term_hits"] = with_views("reports", *TYPED, *KB, _HITS) + (
    "SELECT report_id, exam_type, termo, peso FROM hits WHERE peso = 'ALTO'"
)
O["kb_stats"] = with_views("reports", *TYPED, *KB, _HITS) + (
    "SELECT exam_type, count(*) FILTER (WHERE peso = 'ALTO') AS alto, count(*) FILTER (WHERE peso = 'MÉDIO') AS medio, "
    "count(*) FILTER (WHERE peso = 'BAIXO') AS baixo FROM hits GROUP BY exam_type"
)
_TOKEN = "CASE tok " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in L.TOKEN_ALIASES.items()) + " ELSE tok END"
_NEEDED = f"needed AS (SELECT exam_type, condicao, diagnostico, list_transform(string_split(condicao, ' + '), lambda tok: {_TOKEN}) AS need FROM compounds)"
_RULE_TOKENS = ", ".join(
    f"CASE WHEN exam_type = {q(kind)} AND {has('low', p)} THEN {q(token)} END" for kind, rules in L.TOKEN_PATTERNS.items() for token, p in rules
)


def found_tokens(source: str, body: str) -> str:
    known = f"coalesce(string_split({findings(body, 'low')}, '|'), [])"
    return f"found AS (SELECT report_id, exam_type, list_concat({known}, list_filter([{_RULE_TOKENS}], lambda t: t IS NOT NULL)) AS achados FROM {source})"


_FIRING = (
    "SELECT f.report_id, f.exam_type, n.condicao, n.diagnostico FROM found f JOIN needed n ON f.exam_type = n.exam_type "
    "AND list_has_all(f.achados, n.need)"
)
O["compound_diagnoses"] = with_views("reports", *PIPELINE, *KB, found_tokens("final", "safe_body"), _NEEDED) + _FIRING
_RULES_LOW = "rule_low AS (SELECT *, lower(text) AS low FROM rule_reports)"
O["compound_diagnoses_every_rule"] = with_views("rule_reports", _RULES_LOW, *KB, found_tokens("rule_low", "text"), _NEEDED) + _FIRING
O["kb_variant_hits"] = with_views("rule_reports", _RULES_LOW, *KB) + (
    "SELECT DISTINCT r.report_id, r.exam_type, t.termo, t.peso FROM rule_low r JOIN "
    "(SELECT exam_type, termo, peso, unnest(list_append(variantes, termo)) AS form FROM terms) t "
    "ON r.exam_type = t.exam_type AND contains(r.low, lower(t.form))"
)
O["kb_term_hits_indexed"] = O["kb_term_hits"]
O["form_hits_large"] = with_views(
    "word_forms", "lows AS (SELECT doc_id, lang, lower(text) AS low FROM documents)", "fs AS (SELECT DISTINCT exam_type, lower(form) AS form FROM word_forms)"
) + (
    "SELECT doc_id, exam_type, count(*) AS forms, sum(length(form)) AS form_chars, min(form) AS first_form, max(form) AS last_form "
    "FROM lows JOIN fs ON lang = exam_type AND contains(low, form) GROUP BY ALL"
)
O["classify_by_rule_table"] = with_views(
    "rule_forms", "lows AS (SELECT doc_id, lower(text) AS low FROM documents)", "fs AS (SELECT DISTINCT exam_type, lower(form) AS form FROM rule_forms)",
    "scores AS (SELECT doc_id, exam_type, count(*) AS score FROM lows JOIN fs ON contains(low, form) GROUP BY ALL)",
    "best AS (SELECT doc_id, exam_type, score FROM scores QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, exam_type) = 1)",
) + f"SELECT doc_id, coalesce(exam_type, {q(R.UNKNOWN_EXAM)}) AS exam_type, coalesce(score, 0) AS score FROM lows LEFT JOIN best USING (doc_id)"
O["compound_diagnoses_many_rules"] = with_views(
    "line_findings line_rules", "needs AS (SELECT DISTINCT exam_type, condicao, diagnostico, unnest(string_split(condicao, ' + ')) AS token FROM line_rules)",
    "sizes AS (SELECT exam_type, condicao, count(*) AS n FROM needs GROUP BY ALL)",
    "met AS (SELECT report_id, exam_type, condicao, diagnostico, count(*) AS n FROM (SELECT DISTINCT * FROM line_findings) JOIN needs USING (exam_type, token) GROUP BY ALL)",
) + (
    "SELECT report_id, exam_type, count(*) AS rules, count(*) FILTER (WHERE diagnostico = 'd3') AS of_three, min(condicao) AS first_rule, max(condicao) AS last_rule "
    "FROM met JOIN sizes USING (exam_type, condicao, n) GROUP BY ALL"
)
_NUMBER = r"(?i)" + R.AHI
O["severity_by_range"] = with_views(
    "reports", f"idx AS (SELECT report_id, TRY_CAST(replace({group('text', _NUMBER)}, ',', '.') AS DOUBLE) AS iah FROM reports)"
) + (
    "SELECT report_id, iah, CASE WHEN iah >= 30 THEN 'grave' WHEN iah >= 15 THEN 'moderado' WHEN iah >= 5 THEN 'leve' "
    "WHEN iah >= 0 THEN 'normal' END AS gravidade FROM idx"
)
BLOCKS = (
    "tb AS (SELECT exam_type, string_agg('  - \"' || termo || '\" (também: ' || array_to_string(variantes, ' / ') || '): ' || significado, "
    "chr(10) ORDER BY ord) AS t FROM terms WHERE peso = 'ALTO' GROUP BY exam_type)",
    "cb AS (SELECT exam_type, string_agg('  - ' || condicao || ' → ' || diagnostico, chr(10) ORDER BY ord) AS c FROM compounds GROUP BY exam_type)",
    f"blocks AS (SELECT exam_type, {q(PT.BLOCK_TITLE)} || chr(10) || t || coalesce(chr(10) || chr(10) || {q(PT.COMPOUND_TITLE)} || chr(10) || c, '') AS block "
    "FROM tb LEFT JOIN cb USING (exam_type))",
)
O["lexical_block"] = with_views("reports", *TYPED, *KB, *BLOCKS, COUNTS) + (
    "SELECT exam_type, reports, block FROM counts LEFT JOIN blocks USING (exam_type)"
)
_BASE = "CASE exam_type " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in PT.BASE_PROMPTS.items()) + f" ELSE {q(PT.BASE_PROMPTS['generico'])} END"


def prompt(column: str) -> str:
    return (
        f"{_BASE} || chr(10) || chr(10) || coalesce(block || chr(10) || chr(10), '') || {q(PT.TEXT_TITLE)} || chr(10) || "
        f"'\"\"\"' || chr(10) || {column} || chr(10) || '\"\"\"'"
    )


O["build_prompt"] = with_views("reports", *TYPED, *KB, *BLOCKS) + (
    f"SELECT report_id, exam_type, sha256({prompt('text')}) AS prompt_hash FROM typed LEFT JOIN blocks USING (exam_type)"
)
O["batch_prompts"] = with_views(
    "reports", *PIPELINE, *KB, *BLOCKS,
    f"prompts AS (SELECT report_id, exam_type, {prompt('safe_body')} AS prompt FROM final LEFT JOIN blocks USING (exam_type) WHERE NOT low_confidence)",
    "sized AS (SELECT *, 2 * length(prompt) > 8000 AS own, CASE WHEN 2 * length(prompt) > 8000 THEN 0 ELSE length(prompt) END AS chars, "
    "substr(md5(CAST(report_id AS VARCHAR)), 1, 3) AS run FROM prompts)",
    "summed AS (SELECT *, sum(chars) OVER w - chars AS start, sum(CAST(own AS INTEGER)) OVER w AS nth, max(chars) OVER () AS m FROM sized "
    "WINDOW w AS (ORDER BY run, report_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))",
) + "SELECT report_id, exam_type, CAST(CASE WHEN own THEN -nth ELSE start // (8000 - m + 1) END AS BIGINT) AS batch, sha256(prompt) AS prompt_hash FROM summed"
_CONDITIONS = (
    f"db AS (SELECT exam_type, {q(PT.CONDITION_TITLE)} || chr(10) || string_agg('  - ' || nome || ' (' || replace(cid10, '|', ', ') || '): ' || "
    f"array_to_string(string_split(achados, '|')[1:{PT.MAX_KEY_FINDINGS}], '; '), chr(10) ORDER BY ord) AS d FROM conditions GROUP BY exam_type)",
    "full_blocks AS (SELECT exam_type, block || coalesce(chr(10) || chr(10) || d, '') AS block FROM blocks LEFT JOIN db USING (exam_type))",
)
O["lexical_block_supplement"] = with_views("reports conditions", *TYPED, *KB, *BLOCKS, *_CONDITIONS, COUNTS) + (
    "SELECT exam_type, reports, block FROM counts LEFT JOIN full_blocks USING (exam_type)"
)
O["parse_llm_output"] = with_views("llm_answers", "p AS (SELECT *, TRY_CAST(answer AS JSON) AS j FROM llm_answers)") + (
    "SELECT report_id, coalesce(j ->> 'is_valid_exam' <> 'false', true) OR (j ->> 'summary') IS NULL OR (j ->> 'findings') IS NULL OR (j ->> 'diagnostics') IS NULL AS is_valid_exam, j ->> 'summary' AS summary, "
    "coalesce(array_to_string(CAST(j ->> 'findings' AS VARCHAR[]), '|'), '') AS findings, j ->> 'normal_standards' AS normal_standards, "
    "coalesce(array_to_string(CAST(j ->> 'diagnostics' AS VARCHAR[]), '|'), '') AS diagnostics, "
    "coalesce(j ->> 'succinct_insight', '') AS succinct_insight, CASE WHEN answer IS NULL THEN 'no answer' "
    "WHEN j IS NULL THEN 'unreadable answer' WHEN (j ->> 'error') IS NOT NULL THEN j ->> 'error' "
    "WHEN (j ->> 'summary') IS NULL OR (j ->> 'findings') IS NULL OR (j ->> 'diagnostics') IS NULL THEN 'missing field' END AS error FROM p"
)

_TOLD = (
    "p AS (SELECT *, TRY_CAST(answer AS JSON) AS j FROM llm_answers)",
    f"told AS ({O['parse_llm_output'].rpartition(chr(10) + 'SELECT ')[2].join(['SELECT ', ''])})",
)
_GONE = "NOT low_confidence AND NOT is_valid_exam"
O["result_struct_full"] = with_views("reports llm_answers", *PIPELINE, *_TOLD) + (
    "SELECT report_id, CASE WHEN low_confidence OR NOT is_valid_exam THEN 'low_confidence' ELSE 'completed' END AS status, "
    + ", ".join(f"CASE WHEN NOT ({_GONE}) THEN {v} END AS {k}" for k, v in _PATIENT.items())
    + ", CASE WHEN NOT low_confidence AND is_valid_exam THEN 'true' END AS is_valid_exam"
    + "".join(f", CASE WHEN NOT low_confidence AND is_valid_exam THEN {c} END AS {c}" for c in ("summary", "succinct_insight", "error"))
    + " FROM final JOIN told USING (report_id)"
)

# ------------------------------------------------------------------ drifting JSON

_FENCE = r"(?s)```json\s*(.*?)\s*```"
O["strip_code_fence"] = with_views("vision_outputs", _FENCED) + (
    f"SELECT filename, nullif({group('answer', _FENCE)}, '') AS json_text FROM answers"
)


def _num(path: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract(j ->> '{path}', '(\\d+)', 1), '') AS INTEGER)"


O["normalize_case"] = with_views(
    "vision_outputs", _FENCED, f"parsed AS (SELECT batch_id, filename, CAST(nullif({group('answer', _FENCE)}, '') AS JSON) AS j FROM answers)"
) + (
    "SELECT batch_id, filename, CASE lower(substr(j ->> '$.dados_demograficos.sexo', 1, 1)) WHEN 'm' THEN 'Masculino' WHEN 'f' THEN 'Feminino' END AS sexo, "
    f"{_num('$.dados_demograficos.idade')} AS idade_anos, j ->> '$.dados_demograficos.data_exame' AS data_exame, "
    "CASE WHEN j ->> '$.parecer_audiologico.od' IS NULL THEN j ->> '$.parecer_audiologico' END AS parecer, "
    "j ->> '$.parecer_audiologico.od' AS parecer_od, j ->> '$.parecer_audiologico.oe' AS parecer_oe, "
    f"{_num('$.valores_exame.LRF_OD')} AS lrf_od_db, {_num('$.valores_exame.LRF_OE')} AS lrf_oe_db, "
    f"{_num('$.valores_exame.IPRF_OD')} AS iprf_od_pct, {_num('$.valores_exame.IPRF_OE')} AS iprf_oe_pct, "
    "j ->> '$.valores_exame.timpanometria_OD' AS timpanometria_od, j ->> '$.valores_exame.timpanometria_OE' AS timpanometria_oe FROM parsed"
)
O["drift_report"] = with_views(
    "vision_outputs", _FENCED, f"texts AS (SELECT nullif({group('answer', _FENCE)}, '') AS j FROM answers)",
    "numbered AS (SELECT row_number() OVER () AS n, TRY_CAST(j AS JSON) AS j, j IS NULL AS absent FROM texts)",
    "found AS (SELECT DISTINCT n, regexp_replace(t.fullkey, '\\[[0-9]+\\]', '[]', 'g') AS path, CASE t.type WHEN 'VARCHAR' THEN 'string' WHEN 'NULL' THEN 'null' "
    "WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'number' END AS kind FROM numbered, json_tree(numbered.j) t WHERE numbered.j IS NOT NULL "
    "UNION ALL SELECT n, '$', CASE WHEN absent THEN 'absent' ELSE 'unreadable' END FROM numbered WHERE j IS NULL)",
) + "SELECT path, kind, count(*) AS documents FROM found GROUP BY ALL"
O["get_job_result"] = with_views("jobs") + (
    "SELECT job_id, status, result_json ->> '$.safe_text_snippet' AS snippet, result_json IS NULL AS no_result FROM jobs"
)

# ------------------------------------------------------------------ job state and feedback

O["create_job"] = with_views("job_events") + (
    "SELECT job_id, seq, status, message FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS rn FROM job_events) WHERE rn = 1"
)
O["create_job_new"] = with_views("job_events validations") + (
    "SELECT job_id, seq, status FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS rn FROM job_events) "
    "WHERE rn = 1 AND job_id NOT IN (SELECT job_id FROM validations)"
)
_FOLDED = (
    "SELECT DISTINCT job_id, max(seq) OVER w AS seq, last_value(status) OVER w AS status, last_value(message) OVER w AS message, "
    "last_value(nullif(result_json, '{}') IGNORE NULLS) OVER w AS result_json, last_value(patient_token IGNORE NULLS) OVER w AS patient_token, "
    "last_value(exam_type IGNORE NULLS) OVER w AS exam_type, max(\"at\") OVER w AS updated_at FROM job_events "
    "WINDOW w AS (PARTITION BY job_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
)
O["job_current_state"] = O["stream_job_state"] = O["update_results"] = with_views("job_events") + _FOLDED
ENRICHED = (
    "enriched AS (SELECT v.id, v.job_id, j.patient_token, j.exam_type, v.is_correct, v.corrections, v.validated_at, j.filename "
    "FROM validations v LEFT JOIN jobs j ON v.job_id = j.job_id)",
    "feedback AS (SELECT v.id, j.exam_type, substr(j.result_json ->> '$.safe_text_snippet', 1, 500) AS original_text, "
    "substr(v.corrections, 1, 500) AS corrected_text, v.job_id AS source_job_id, v.validated_at AS created_at "
    "FROM validations v JOIN jobs j ON v.job_id = j.job_id WHERE v.is_correct = 0 AND v.corrections <> '' "
    "AND j.result_json ->> '$.safe_text_snippet' NOT IN ('', '...'))",
    "status AS (SELECT j.*, CASE l.is_correct WHEN 1 THEN 'validated_ok' WHEN 0 THEN 'validated_with_errors' ELSE 'pending_validation' END "
    "AS validation_status FROM jobs j LEFT JOIN (SELECT job_id, arg_max(is_correct, id) AS is_correct FROM validations GROUP BY job_id) l ON j.job_id = l.job_id)",
    "retrain AS (SELECT e.id, s.job_id, s.filename, e.exam_type, e.corrections, s.file_path, regexp_extract(s.file_path, '[^/]+$') AS image_file "
    "FROM status s JOIN enriched e ON s.job_id = e.job_id WHERE s.validation_status = 'validated_with_errors' AND s.file_path IS NOT NULL)",
)
FEEDBACK = with_views("jobs validations", *ENRICHED)
O["scan_feedback"] = FEEDBACK + "SELECT id, exam_type, original_text, corrected_text, source_job_id FROM feedback"
O["display_truncate"] = FEEDBACK + (
    "SELECT id, substr(original_text, 1, 120) AS original_text, substr(corrected_text, 1, 120) AS corrected_text FROM feedback"
)
O["update_validation_status"] = FEEDBACK + "SELECT job_id, status, validation_status FROM status"
O["save_validation"] = FEEDBACK + "SELECT id, job_id, patient_token, exam_type, is_correct, corrections FROM enriched"
O["lexical_feedback"] = FEEDBACK + "SELECT * REPLACE (CAST(created_at AS VARCHAR) AS created_at) FROM feedback"
_BY_EXAM = "SELECT exam_type, count(*) AS validations FROM enriched WHERE exam_type IS NOT NULL GROUP BY exam_type"
O["lexical_stats"] = FEEDBACK + (
    "SELECT (SELECT count(*) FROM jobs WHERE status = 'completed') AS total_completed_jobs, "
    "(SELECT count(*) FROM validations) AS total_validations, "
    "(SELECT count(*) FROM validations WHERE is_correct = 0) AS corrections_submitted, "
    "(SELECT count(*) FROM feedback) AS lexical_feedback_entries, "
    f"(SELECT string_agg(exam_type || '=' || CAST(validations AS VARCHAR), '|' ORDER BY exam_type) FROM ({_BY_EXAM})) AS validations_by_exam"
)
O["lexical_stats_kept"] = O["lexical_stats"]
O["validations_by_exam"] = O["stream_validations"] = FEEDBACK + _BY_EXAM
O["corrections_report"] = FEEDBACK + (
    "SELECT id, exam_type, corrections, CAST(validated_at AS VARCHAR) AS validated_at, filename FROM enriched WHERE is_correct = 0 "
    "ORDER BY validated_at DESC, id DESC"
)
O["feedback_report"] = FEEDBACK + (
    "SELECT id, exam_type, substr(original_text, 1, 120) AS original_text, substr(corrected_text, 1, 120) AS corrected_text, "
    "CAST(created_at AS VARCHAR) AS created_at FROM feedback ORDER BY created_at DESC, id DESC"
)
O["job_listing"] = FEEDBACK + (
    "SELECT job_id, filename, exam_type, status, patient_token, CAST(created_at AS VARCHAR) AS created_at FROM jobs ORDER BY created_at DESC, job_id DESC"
)
O["validation_listing"] = FEEDBACK + (
    "SELECT id, job_id, exam_type, CASE WHEN is_correct = 1 THEN 'CORRETO' ELSE 'CORRIGIDO' END AS tag, corrections, "
    "CAST(validated_at AS VARCHAR) AS validated_at FROM enriched ORDER BY validated_at DESC, id DESC"
)
O["kb_patch_suggestions"] = with_views("jobs validations", *ENRICHED, *KB) + (
    f"SELECT DISTINCT f.exam_type, w.word FROM feedback f JOIN (SELECT unnest([{', '.join(q(w) for w in R.WATCH_WORDS)}]) AS word) w "
    "ON contains(lower(f.corrected_text), w.word) WHERE NOT EXISTS (SELECT 1 FROM terms t WHERE t.exam_type = f.exam_type AND contains(t.termo, w.word))"
)
O["retrain_set"] = FEEDBACK + "SELECT * FROM retrain"
WITH_FILES = with_views("jobs validations uploaded_files", *ENRICHED, "present AS (SELECT path FROM uploaded_files WHERE present)")
O["retrain_set_existing"] = WITH_FILES + "SELECT * FROM retrain WHERE file_path IN (SELECT path FROM present)"
O["export_retrain_set"] = WITH_FILES + (
    "SELECT job_id, filename, exam_type, corrections, image_file FROM retrain WHERE file_path IN (SELECT path FROM present)"
)
O["retrain_missing"] = WITH_FILES + (
    "SELECT job_id, file_path FROM status WHERE validation_status = 'validated_with_errors' AND file_path IS NOT NULL "
    "AND file_path NOT IN (SELECT path FROM present)"
)
_SEED_JOBS = "SELECT * REPLACE (NULL::VARCHAR AS result_json, '[redacted]' AS filename, CAST(created_at AS VARCHAR) AS created_at{0}) FROM jobs"
O["redact_seed_jobs"] = with_views("jobs") + _SEED_JOBS.format("")
O["redact_seed_jobs_strict"] = with_views("jobs") + _SEED_JOBS.format(", NULL::VARCHAR AS file_path, NULL::VARCHAR AS message")
O["redact_seed_feedback"] = FEEDBACK + (
    "SELECT id, exam_type, CASE WHEN length(original_text) > 100 THEN '[redacted]' ELSE original_text END AS original_text, corrected_text, source_job_id FROM feedback"
)


def exported(name: str, source: str, columns: str) -> str:
    values = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '-')" for c in columns.split())
    return f"SELECT '{name}' AS table_name, concat_ws('|', {values}) AS row_text FROM {source}"


_JOB_COLUMNS = "job_id patient_token filename exam_type status message result_json file_path"
_VALIDATION_ROWS = exported("validations", "enriched", "id job_id patient_token exam_type is_correct corrections")
_FEEDBACK_COLUMNS = "id exam_type original_text corrected_text source_job_id"
O["export_seed"] = FEEDBACK + " UNION ALL ".join(
    [
        exported("jobs", "(SELECT * REPLACE (NULL::VARCHAR AS result_json, '[redacted]' AS filename) FROM jobs)", _JOB_COLUMNS),
        _VALIDATION_ROWS,
        exported("lexical_feedback", "(SELECT * REPLACE (CASE WHEN length(original_text) > 100 THEN '[redacted]' ELSE original_text END AS original_text) FROM feedback)", _FEEDBACK_COLUMNS),
    ]
)
O["export_tables"] = FEEDBACK + " UNION ALL ".join([exported("jobs", "jobs", _JOB_COLUMNS), _VALIDATION_ROWS, exported("lexical_feedback", "feedback", _FEEDBACK_COLUMNS)])
O["enrich_validations_as_of"] = with_views("job_events") + (
    "SELECT id, job_id, patient_token, exam_type FROM (SELECT seq AS id, job_id, last_value(patient_token IGNORE NULLS) OVER w AS patient_token, "
    "last_value(exam_type IGNORE NULLS) OVER w AS exam_type FROM job_events "
    "WINDOW w AS (PARTITION BY job_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"
)
O["job_full_rows"] = with_views("job_events") + (
    "SELECT job_id, arg_min(message, seq) || '.pdf' AS filename, arg_max(exam_type, seq) FILTER (WHERE exam_type IS NOT NULL) AS exam_type, "
    "arg_max(status, seq) AS status, arg_max(patient_token, seq) FILTER (WHERE patient_token IS NOT NULL) AS patient_token, "
    "CAST(arg_min(\"at\", seq) AS VARCHAR) AS created_at, '/up/' || CAST(min(seq) AS VARCHAR) AS file_path, CAST(max(\"at\") AS VARCHAR) AS updated_at "
    "FROM job_events GROUP BY job_id"
)
O["stream_enriched_validations"] = with_views("job_events validations", f"folded AS ({_FOLDED})") + (
    "SELECT id, job_id, patient_token, exam_type, is_correct, corrections, CAST(validated_at AS VARCHAR) AS validated_at FROM validations LEFT JOIN folded USING (job_id)"
)
