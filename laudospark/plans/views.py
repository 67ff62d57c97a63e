"""SQL that derives report, job and feedback tables from the generic benchmark tables.

The texts run unchanged in Spark SQL and in the SQL engine that checks the results, so both sides see
the same rows. They only build inputs; no operator of the library is used in them. All keep every row
of the tables they read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.regex import compute_once
from ..sources.readers import ensure_parallelism

# Columns read per table; narrow reads keep the repartitioning of small inputs cheap.
COLUMNS = {
    "orders": ["o_orderkey", "o_custkey", "o_orderdate"],
    "customer": ["c_custkey", "c_name", "c_nationkey"],
    "events": ["event_id", "ts", "user_id", "event_type"],
    "documents": ["doc_id", "text", "lang", "source"],
    "labels": ["doc_id", "quality", "toxic"],
    "lineitem": ["l_orderkey", "l_linenumber", "l_quantity"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
}

REPORTS = """
SELECT o_orderkey AS report_id,
  CASE WHEN o_orderkey % 3 = 0 THEN 'scan_' ELSE 'doc_' END || CAST(o_orderkey AS STRING)
    || CASE WHEN o_orderkey % 3 = 0 THEN '.PNG' ELSE '.pdf' END AS filename,
  CASE WHEN o_orderkey % 17 = 0 THEN 'Laudo curto' ELSE
  'CLINICA ' || CAST(c_nationkey AS STRING) || chr(10)
  || CASE WHEN o_custkey % 13 = 0 THEN '' ELSE 'Paciente: ' || translate(c_name, '#0123456789', ' abcdefghij') || chr(10) END
  || 'CPF: ' || lpad(CAST(o_custkey % 1000 AS STRING), 3, '0') || '.456.789-' || lpad(CAST(o_orderkey % 100 AS STRING), 2, '0') || chr(10)
  || CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'Realizado em: ' WHEN 2 THEN 'Emissao: ' ELSE 'Data do Exame: ' END
  || CASE o_orderkey % 4
     WHEN 0 THEN CAST(day(o_orderdate) AS STRING) || '-' || CAST(month(o_orderdate) AS STRING) || '-' || CAST(year(o_orderdate) AS STRING)
     WHEN 1 THEN CAST(day(o_orderdate) AS STRING) || '.' || CAST(month(o_orderdate) AS STRING) || '.' || CAST(year(o_orderdate) % 100 AS STRING)
     ELSE lpad(CAST(day(o_orderdate) AS STRING), 2, '0') || '/' || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || '/' || CAST(year(o_orderdate) AS STRING) END || chr(10)
  || CASE WHEN o_custkey % 7 = 0 THEN 'RG: 12.345.' || lpad(CAST(o_custkey % 1000 AS STRING), 3, '0') || '-X' || chr(10) ELSE '' END
  || CASE WHEN o_custkey % 5 = 0 THEN 'Nasc. D.N.: ' ELSE 'Nascimento: ' END || '15/03/19' || lpad(CAST(40 + o_custkey % 60 AS STRING), 2, '0') || chr(10)
  || CASE WHEN o_custkey % 11 = 0 THEN '' ELSE 'Idade: ' || CAST(20 + o_custkey % 60 AS STRING) || ' anos' || chr(10) END
  || 'Sexo: ' || CASE o_custkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'Masculino' ELSE 'nao informado' END || chr(10)
  || CASE WHEN o_custkey % 4 = 0 THEN 'Cargo: Serralheiro / Soldador' || chr(10) ELSE '' END
  || CASE WHEN o_orderkey % 7 = 2 THEN 'Convenio: Saude ' || CAST(o_custkey % 9 AS STRING) || chr(10) || '-' || chr(10) ELSE '' END
  || CASE WHEN o_orderkey % 7 = 3 THEN 'N pedido: ' || CAST(o_orderkey AS STRING) || chr(10) || '-' || chr(10) ELSE '' END
  || CASE o_orderkey % 9
     WHEN 0 THEN 'Audiometria tonal e vocal' || chr(10)
       || CASE o_custkey % 6 WHEN 0 THEN 'Perda auditiva mista' WHEN 1 THEN 'Hipoacusia condutiva' WHEN 2 THEN 'Normoacusia' WHEN 3 THEN 'Curva sem classe' ELSE 'Perda auditiva neurossensorial' END
       || CASE o_custkey % 5 WHEN 0 THEN ' bilateral' WHEN 1 THEN ' em orelha direita' WHEN 2 THEN ' em OE' WHEN 3 THEN ' quanto ao limiar' ELSE '' END
       || CASE o_custkey % 8 WHEN 0 THEN ' de grau moderado a severo' WHEN 1 THEN ' de grau severo' WHEN 2 THEN ' com anacusia' WHEN 3 THEN ' de grau moderado' WHEN 4 THEN ' de grau leve a moderado' WHEN 5 THEN ' de grau leve' ELSE '' END
       || '. SRT: ' || CAST(o_orderkey % 90 AS STRING) || ' dB. IPRF: ' || CAST(o_orderkey % 100 AS STRING) || '%.'
       || CASE o_custkey % 4 WHEN 0 THEN ' Sugiro BERA.' WHEN 1 THEN ' Sugiro timpanometria e PEATE.' WHEN 2 THEN ' Avaliar queixa otoneurologica.' ELSE '' END
     WHEN 1 THEN 'Potencial evocado auditivo' || chr(10) || 'Onda I: 1.' || CAST(o_orderkey % 10 AS STRING) || ' ms.'
       || CASE WHEN o_custkey % 3 = 0 THEN '' ELSE ' Onda III: 3.9 ms.' END || ' Onda V: 5.8 ms. limiar: ' || CAST(o_orderkey % 90 AS STRING) || ' dB. Registro reprodutivel.'
     WHEN 2 THEN 'Tomografia dos seios da face' || chr(10) || 'Espessamento mucoso no seio ' || CASE o_custkey % 4 WHEN 0 THEN 'maxilar' WHEN 1 THEN 'etmoidal' WHEN 2 THEN 'esfenoidal' ELSE 'frontal e maxilar' END
       || CASE o_custkey % 4 WHEN 0 THEN ' direito' WHEN 1 THEN ' bilateral' WHEN 2 THEN ' esquerdo' ELSE '' END || CASE WHEN o_custkey % 3 = 0 THEN ' com nivel liquido' ELSE ' com velamento parcial' END
       || '. Concha bolhosa. Desvio do septo. Liberado CRM 12345-SP'
     WHEN 3 THEN 'Tomografia de mastoide' || chr(10) || 'Colesteatoma na orelha ' || CASE o_custkey % 2 WHEN 0 THEN 'esquerda' ELSE 'direita' END || ', ossos temporais com tegmen tympani preservado.'
       || CASE WHEN o_custkey % 3 = 0 THEN ' Erosao ossicular.' ELSE '' END || ' Massa de partes moles. CRM 98765'
     WHEN 4 THEN 'Tomografia de pescoco' || chr(10) || 'Linfonodomegalia cervical' || CASE WHEN o_custkey % 3 = 0 THEN ' com necrose central' ELSE '' END || ', nivel IIa e nivel ' || CASE o_custkey % 2 WHEN 0 THEN 'III' ELSE 'vb' END || '. Cisto branquial ausente neste exame.'
     WHEN 5 THEN 'Polissonografia' || chr(10) || 'IAH ' || CAST(o_orderkey % 50 AS STRING) || CASE WHEN o_custkey % 2 = 0 THEN '.5' ELSE '' END || ' eventos por hora. Oximetria basal normal, hipopneia presente no sono rem.'
     WHEN 6 THEN 'Videolaringoscopia' || chr(10) || 'Laringe com prega vocal direita edemaciada, glote pervia, sem paralisia vocal.'
     WHEN 7 THEN 'Videoendoscopia nasal' || chr(10) || 'Corneto inferior hipertrofico, meato medio livre, septo nasal centrado, sem polipose nasal.'
     ELSE 'Resultado' || chr(10) || 'Exame sem palavras reconhecidas pelo classificador, texto longo o bastante para passar na guarda.' END
  END AS text
FROM orders JOIN customer ON o_custkey = c_custkey
"""

OCR_CANDIDATES = """
SELECT o_orderkey AS report_id, s.strategy, s.ord,
  repeat('x', CAST((o_orderkey * s.ord) % 7 AS INT)) || CASE WHEN s.ord = 3 THEN '  ' ELSE '' END AS text
FROM orders CROSS JOIN (SELECT 'original' AS strategy, 1 AS ord UNION ALL SELECT 'enhanced', 2
  UNION ALL SELECT 'binarize', 3 UNION ALL SELECT 'sparse', 4) s
"""

REPORT_PAGES = """
SELECT l_orderkey AS report_id, CAST(l_linenumber AS INT) AS page,
  CASE WHEN l_linenumber % 5 = 4 THEN '' ELSE 'pagina ' || CAST(l_linenumber AS STRING) || ' de ' || CAST(l_orderkey AS STRING) END AS text
FROM lineitem
"""

JOB_EVENTS = """
SELECT user_id AS job_id, event_id AS seq, ts AS at,
  CASE event_type WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'processing' END AS status,
  event_type || ' ' || CAST(event_id AS STRING) AS message,
  CASE WHEN event_type = 'purchase' THEN '{"safe_text_snippet":"v' || CAST(event_id AS STRING) || '..."}' WHEN event_type = 'click' THEN '{}' END AS result_json,
  CASE WHEN event_type IN ('view', 'purchase') THEN 'pt-' || substr(md5(CAST(user_id AS STRING)), 1, 12) END AS patient_token,
  CASE WHEN event_type = 'purchase' THEN CASE event_id % 3 WHEN 0 THEN 'audiometria' WHEN 1 THEN 'bera' ELSE 'tomografia' END END AS exam_type
FROM events
"""

JOBS = """
SELECT doc_id AS job_id, 'pt-' || substr(md5(source || lang), 1, 12) AS patient_token,
  source || '_' || CAST(doc_id AS STRING) || '.pdf' AS filename,
  CASE lang WHEN 'en' THEN 'audiometria' WHEN 'fr' THEN 'bera' WHEN 'de' THEN 'tomografia' END AS exam_type,
  CASE doc_id % 5 WHEN 0 THEN 'low_confidence' WHEN 1 THEN 'failed' ELSE 'completed' END AS status,
  'mensagem ' || source AS message,
  CASE WHEN doc_id % 5 > 1 THEN '{"safe_text_snippet":"' || CASE WHEN doc_id % 11 = 0 THEN '...' ELSE repeat('trecho ' || CAST(doc_id AS STRING) || ' ', CAST(1 + doc_id % 90 AS INT)) || '...' END || '"}' END AS result_json,
  CASE WHEN doc_id % 7 <> 0 THEN '/up/' || CAST(doc_id AS STRING) || '_' || source || '.pdf' END AS file_path,
  TIMESTAMP '2026-01-01 00:00:00' + doc_id % 50 * INTERVAL '1' HOUR AS created_at
FROM documents
"""

VALIDATIONS = """
SELECT doc_id * 2 + rep AS id, doc_id AS job_id, CASE WHEN quality = rep % 2 THEN 1 ELSE 0 END AS is_correct,
  CASE WHEN toxic = 1 THEN '' WHEN doc_id % 4 = 0 THEN 'Corneto com esporão e obliteração' WHEN doc_id % 4 = 1 THEN 'Concha BOLHOSA paradoxal' END AS corrections,
  TIMESTAMP '2026-02-01 00:00:00' + doc_id % 30 * INTERVAL '1' HOUR AS validated_at
FROM labels CROSS JOIN (SELECT 0 AS rep UNION ALL SELECT 1) r
"""

LLM_ANSWERS = """
SELECT o_orderkey AS report_id,
  CASE o_orderkey % 6
   WHEN 0 THEN '{"is_valid_exam": false, "summary": "ilegivel", "findings": [], "diagnostics": []}'
   WHEN 1 THEN '{"error": "timeout", "summary": "Erro"}'
   WHEN 2 THEN 'resposta que nao abre'
   WHEN 3 THEN '{"summary": "s' || CAST(o_orderkey AS STRING) || '", "findings": ["a", "b' || CAST(o_custkey AS STRING) || '"], "diagnostics": ["d"], "normal_standards": "n", "succinct_insight": "i"}'
   WHEN 4 THEN NULL
   ELSE '{"is_valid_exam": true, "summary": "s", "findings": ["a"], "normal_standards": null, "diagnostics": []}' END AS answer
FROM orders
"""

VISION_OUTPUTS = """
SELECT batch_id,
  '{"' || CAST(batch_id AS STRING) || '_a.jpg": "```json' || chr(92) || 'n' || replace(inner_json, '"', chr(92) || '"') || chr(92) || 'n```", "'
    || CAST(batch_id AS STRING) || '_b.jpg": "texto sem cerca"}' AS document
FROM (SELECT o_orderkey AS batch_id,
  '{"dados_demograficos": {"nome": "X", "sexo": "' || CASE WHEN o_custkey % 2 = 0 THEN 'F' ELSE 'masculino' END
  || '", "idade": ' || CASE WHEN o_custkey % 3 = 0 THEN CAST(o_custkey % 90 AS STRING) ELSE '"' || CAST(o_custkey % 90 AS STRING) || ' anos"' END
  || ', "data_exame": "0' || CAST(1 + o_custkey % 9 AS STRING) || '/02/2025"}, "parecer_audiologico": '
  || CASE WHEN o_custkey % 2 = 0 THEN '"normal"' ELSE '{"od": "leve", "oe": "severa"}' END
  || ', "valores_exame": {"LRF_OD": ' || CASE WHEN o_custkey % 4 = 0 THEN 'null' WHEN o_custkey % 4 = 1 THEN CAST(o_custkey % 60 AS STRING) ELSE '"' || CAST(o_custkey % 60 AS STRING) || ' dB"' END
  || ', "LRF_OE": "20dB", "IPRF_OD": "' || CAST(o_orderkey % 100 AS STRING) || '%", "IPRF_OE": null, "timpanometria_OD": "A"}}' AS inner_json
  FROM orders) t
"""

CASE_BANK = """
SELECT o_orderkey AS row_no,
  '{"id": "AUD-' || CAST(o_orderkey AS STRING) || '", "filename": "' || CAST(o_orderkey AS STRING) || '.jpg", "procod_data": {"nome": "", "data_nascimento": "", "convenio": ""}, "clinical_data_anonymized": {"idade": "'
  || CASE WHEN o_custkey % 2 = 0 THEN '' ELSE CAST(o_custkey % 80 AS STRING) END || '", "sexo": "", "cargo_funcao": "", "data_exame": "", "parecer_audiologico": "p' || CAST(o_custkey AS STRING) || '", "valores_exame": {"LRF_OD": "' || CAST(o_custkey % 60 AS STRING) || '"}}}' AS document
FROM orders
"""

RAW_DATES = """
SELECT o_orderkey AS report_id, CASE o_orderkey % 8
  WHEN 0 THEN CAST(day(o_orderdate) AS STRING) || '/' || CAST(month(o_orderdate) AS STRING) || '/' || CAST(year(o_orderdate) AS STRING)
  WHEN 1 THEN CAST(year(o_orderdate) AS STRING) || '-' || CAST(month(o_orderdate) AS STRING) || '-' || CAST(day(o_orderdate) AS STRING)
  WHEN 2 THEN CAST(month(o_orderdate) AS STRING) || '.' || CAST(day(o_orderdate) AS STRING) || '.' || CAST(year(o_orderdate) % 100 AS STRING)
  WHEN 3 THEN CAST(day(o_orderdate) AS STRING) || '-' || CAST(month(o_orderdate) AS STRING) || '/' || CAST(year(o_orderdate) AS STRING)
  WHEN 4 THEN CAST(day(o_orderdate) AS STRING) || '/' || CAST(month(o_orderdate) AS STRING) || '/1' || CAST(o_orderkey % 100 AS STRING)
  WHEN 5 THEN ''
  WHEN 6 THEN 'sem data'
  ELSE CAST(month(o_orderdate) AS STRING) || '/' || CAST(10 + day(o_orderdate) AS STRING) || '/' || CAST(year(o_orderdate) AS STRING) END AS raw
FROM orders
"""

UPLOADED_FILES = """
SELECT '/up/' || CAST(doc_id AS STRING) || '_' || source || '.pdf' AS path,
  TIMESTAMP '2026-01-01 00:00:00' + doc_id % 20 * INTERVAL '1' DAY AS modified_at, length(text) % 3 <> 0 AS present
FROM documents
"""

# Each row fulfils one compound rule, in forms that are not the term's own name.
RULE_REPORTS = """
SELECT o_orderkey AS report_id,
  CASE WHEN o_custkey % 11 < 4 THEN 'tomografia' WHEN o_custkey % 11 < 7 THEN 'tomografia_mastoide' WHEN o_custkey % 11 < 9 THEN 'tomografia_pescoco' ELSE 'audiometria' END AS exam_type,
  'Laudo ' || CAST(o_orderkey AS STRING) || '. ' || CASE o_custkey % 11
    WHEN 0 THEN 'Espessamento da mucosa em seio maxilar, com nivel liquido.'
    WHEN 1 THEN 'Infundibulo obliterado a direita, com septo desviado.'
    WHEN 2 THEN 'Curvatura paradoxal do corneto e obliteracao do infundibulo.'
    WHEN 3 THEN 'Velamento total do seio frontal, com nivel hidroaereo.'
    WHEN 4 THEN 'Colesteatoma com erosao da bigorna.'
    WHEN 5 THEN 'Mastoide velada, com falha no tegmen.'
    WHEN 6 THEN 'Massa de partes moles e fistula do canal lateral.'
    WHEN 7 THEN 'Adenopatia cervical com centro necrotico.'
    WHEN 8 THEN 'Tumor de parotida e paralisia facial.'
    WHEN 9 THEN 'Entalhe em 4 kHz, com exposicao ao ruido no trabalho.'
    ELSE 'Gap aereo-osseo em graves, com carhart notch.' END
  || CASE o_orderkey % 4 WHEN 0 THEN ' Recesso infundibular livre, vias de drenagem obliteradas.' WHEN 1 THEN ' Conteúdo líquido e crista óssea septal.' WHEN 2 THEN ' Rebaixamento descendente, anacusia.' ELSE '' END AS text
FROM orders
"""

_DIGITS = "(" + " UNION ALL ".join(f"SELECT {i}" + " AS k" * (i == 0) for i in range(10)) + ")"


def word_forms(per_document: str) -> str:
    """Forms cut out of documents: three words, the end of one and the next, one and the beginning of the next, a part."""
    return f"""
SELECT exam_type, rule_id, form FROM (SELECT lang AS exam_type, rule_id,
  CASE k % 4 WHEN 0 THEN w1 || ' ' || w2 || ' ' || w3 WHEN 1 THEN substr(w1, 3) || ' ' || w2 WHEN 2 THEN w1 || ' ' || substr(w2, 1, 3) ELSE substr(w1, 2, 6) END AS form
  FROM (SELECT lang, doc_id * 100 + k AS rule_id, k, split_part(t, ' ', 2) AS w1, split_part(t, ' ', 3) AS w2, split_part(t, ' ', 4) AS w3
    FROM (SELECT doc_id, lang, k, substr(lower(text), CAST(1 + (doc_id * 71 + k * 137) % (1 + length(text)) AS INT), 90) AS t
      FROM documents CROSS JOIN {per_document} ks) a) b) c
WHERE length(form) >= 5
"""


WORD_FORMS = word_forms(f"(SELECT a.k * 10 + b.k AS k FROM {_DIGITS} a CROSS JOIN {_DIGITS} b)")
RULE_FORMS = word_forms(_DIGITS)

_KIND = "CASE {0}.l_orderkey % 3 WHEN 0 THEN 'audiometria' WHEN 1 THEN 'bera' ELSE 'tomografia' END"
_TOKEN = "'q' || CAST(CAST({0}.l_quantity AS INT) AS STRING)"

LINE_FINDINGS = f"SELECT a.l_orderkey AS report_id, {_KIND.format('a')} AS exam_type, {_TOKEN.format('a')} AS token FROM lineitem a"

# Rules of two and of three tokens, those of the first lines of an order.
LINE_RULES = f"""
SELECT DISTINCT {_KIND.format('a')} AS exam_type, {_TOKEN.format('a')} || ' + ' || {_TOKEN.format('b')} AS condicao, 'd2' AS diagnostico
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2
UNION
SELECT DISTINCT {_KIND.format('a')}, {_TOKEN.format('a')} || ' + ' || {_TOKEN.format('b')} || ' + ' || {_TOKEN.format('c')}, 'd3'
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2
JOIN lineitem c ON a.l_orderkey = c.l_orderkey AND c.l_linenumber = 3
"""

# Reference conditions; lists come as text.
CONDITIONS = """
SELECT CASE n_nationkey % 4 WHEN 0 THEN 'audiometria' WHEN 1 THEN 'bera' WHEN 2 THEN 'tomografia' ELSE 'polissonografia' END AS exam_type, n_nationkey AS ord, n_name AS nome,
  'H' || CAST(60 + n_nationkey AS STRING) || CASE WHEN n_nationkey % 3 = 0 THEN '|J' || CAST(30 + n_regionkey AS STRING) ELSE '' END AS cid10,
  'um|dois' || CASE WHEN n_nationkey % 2 = 0 THEN '|tres|quatro' ELSE '' END AS achados
FROM nation
"""

VIEWS = {
    "reports": (REPORTS, ["orders", "customer"]),
    "ocr_candidates": (OCR_CANDIDATES, ["orders"]),
    "report_pages": (REPORT_PAGES, ["lineitem"]),
    "job_events": (JOB_EVENTS, ["events"]),
    "jobs": (JOBS, ["documents"]),
    "validations": (VALIDATIONS, ["labels"]),
    "llm_answers": (LLM_ANSWERS, ["orders"]),
    "vision_outputs": (VISION_OUTPUTS, ["orders"]),
    "case_bank": (CASE_BANK, ["orders"]),
    "raw_dates": (RAW_DATES, ["orders"]),
    "uploaded_files": (UPLOADED_FILES, ["documents"]),
    "rule_reports": (RULE_REPORTS, ["orders"]),
    "conditions": (CONDITIONS, ["nation"]),
    "word_forms": (WORD_FORMS, ["documents"]),
    "rule_forms": (RULE_FORMS, ["documents"]),
    "line_findings": (LINE_FINDINGS, ["lineitem"]),
    "line_rules": (LINE_RULES, ["lineitem"]),
    "documents": ("SELECT doc_id, text, lang, source FROM documents", ["documents"]),
}


#: Forms that are cut out of each document by these views.
CUT = {WORD_FORMS: 100, RULE_FORMS: 10}
#: Characters that are cut out, and of a part; a cut lies in two parts at most.
CUT_CHARS, PART = 90, 256


def cut_forms(documents: DataFrame, per_document: int) -> DataFrame:
    """The rows of ``word_forms``: a document is put in lower case once, and what is cut out of it leaves it before rows are made.

    A text is parted first, so that a cut does not count the characters from the beginning of the text on.
    """
    parts = F.regexp_extract_all(F.lower("text"), F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))
    low = compute_once(documents.select("doc_id", "lang", "text"), "__low", F.struct(parts.alias("parts"), F.length("text").alias("n")))

    def cut(k: Column) -> Column:
        before = (F.col("doc_id") * 71 + k * 137) % (1 + F.col("__low.n"))
        part = F.floor(before / PART).cast("int")
        near = F.concat(*[F.coalesce(F.get("__low.parts", part + i), F.lit("")) for i in (0, 1)])
        return F.substr(near, (before % PART + 1).cast("int"), F.lit(CUT_CHARS))

    cuts = F.transform(F.sequence(F.lit(0), F.lit(per_document - 1)), lambda k: F.struct(k.alias("k"), cut(k).alias("t")))
    rows = low.select("lang", "doc_id", F.explode(cuts).alias("c")).select("lang", "doc_id", "c.k", F.split("c.t", " ", 5).alias("w"))
    w1, w2, w3 = (F.coalesce(F.get("w", F.lit(i)), F.when(F.col("w").isNotNull(), F.lit(""))) for i in (1, 2, 3))
    kinds = F.when(F.col("k") % 4 == 0, F.concat(w1, F.lit(" "), w2, F.lit(" "), w3)).when(F.col("k") % 4 == 1, F.concat(F.substr(w1, F.lit(3)), F.lit(" "), w2))
    form = kinds.when(F.col("k") % 4 == 2, F.concat(w1, F.lit(" "), F.substr(w2, F.lit(1), F.lit(3)))).otherwise(F.substr(w1, F.lit(2), F.lit(6)))
    made = compute_once(rows, "form", form)
    return made.select(F.col("lang").alias("exam_type"), (F.col("doc_id") * 100 + F.col("k")).alias("rule_id"), "form").where(F.length("form") >= 5)


def load(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """One derived table over all rows of the parquet tables in ``sf_dir``.

    ``laudospark.spreadSmallScans=true`` in the session spreads tables of one row group over the cores; off by default,
    as it shuffles what it spreads.
    """
    spread = spark.conf.get("laudospark.spreadSmallScans", "false") == "true"
    sql, tables = VIEWS[view]
    frames = {}
    for table in tables:
        frame = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*COLUMNS[table])
        frames[table] = ensure_parallelism(frame) if spread and table != "customer" else frame
    if sql in CUT:
        return cut_forms(frames["documents"], CUT[sql])
    return spark.sql(qualified(sql, tables), **frames)


def qualified(sql: str, tables: list[str]) -> str:
    """Put DataFrame placeholders where the table names stand; literal braces are doubled."""
    sql = sql.replace("{", "{{").replace("}", "}}")
    for table in tables:
        for word in ("FROM ", "JOIN "):
            sql = sql.replace(word + table, word + "{" + table + "}")
    return sql
