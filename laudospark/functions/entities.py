"""Entities per exam type as one nullable struct; ``to_json`` leaves the absent ones out."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..rules import patterns as R
from .regex import exact, extract_int, label_patterns, ladder, let, nocase

# The union of all entity fields, in output order
ENTITY_FIELDS = [
    ("decibeis_encontrados", "array<string>"),
    ("tipo_perda", "string"),
    ("lateralidade", "string"),
    ("grau_perda", "string"),
    ("srt_db", "int"),
    ("iprf_pct", "int"),
    ("sugestoes_complementares", "array<string>"),
    ("latencias_ms", "map<string,string>"),
    ("limiar_eletrofisiologico_db", "int"),
    ("seios_afetados", "array<string>"),
    ("achados", "array<string>"),
    ("niveis_cervicais", "array<string>"),
]


def db_values(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(exact(R.DB_VALUES)), F.lit(1))


def loss_type(low: Column) -> Column:
    return ladder(low, R.LOSS_TYPE)


def ear_side(low: Column, compat: bool = True) -> Column:
    steps = R.EAR_SIDE
    if not compat:  # "ao" is mostly a preposition
        steps = [(p.replace(r"|\bao\b", ""), v) for p, v in steps]
    return ladder(low, steps)


def loss_degree(low: Column) -> Column:
    return ladder(low, R.LOSS_DEGREE)


def srt_db(c: Column) -> Column:
    return extract_int(c, R.SRT)


def iprf_pct(c: Column) -> Column:
    return extract_int(c, R.IPRF)


def audio_suggestions(low: Column) -> Column:
    return label_patterns(low, R.AUDIO_SUGGESTIONS)


def bera_latencies(c: Column) -> Column:
    entries = F.array(
        *[
            F.struct(F.lit(w).alias("wave"), F.regexp_extract(c, nocase(R.BERA_WAVE.format(wave=w)), 1).alias("ms"))
            for w in R.BERA_WAVES
        ]
    )
    return F.map_from_entries(F.filter(entries, lambda e: e["ms"] != ""))


def bera_threshold(c: Column) -> Column:
    return extract_int(c, R.BERA_THRESHOLD)


def ct_sinuses(low: Column) -> Column:
    return label_patterns(low, [(s, s) for s in R.SINUSES])


def ct_side(low: Column) -> Column:
    return ladder(low, R.CT_SIDE)


def ct_findings(low: Column, compat: bool = True) -> Column:
    return label_patterns(low, R.CT_FINDINGS, compat)


def mastoid_findings(low: Column, compat: bool = True) -> Column:
    return label_patterns(low, R.MASTOID_FINDINGS, compat)


def mastoid_side(low: Column, compat: bool = True) -> Column:
    return ladder(low, R.MASTOID_SIDE, compat)


def neck_findings(low: Column) -> Column:
    return label_patterns(low, R.NECK_FINDINGS)


def neck_levels(c: Column) -> Column:
    levels = F.transform(F.regexp_extract_all(c, F.lit(exact(R.NECK_LEVELS)), F.lit(1)), F.upper)
    return let(levels, lambda a: F.when(F.size(a) > 0, a))


def parse_audiometry(c: Column, low: Column | None = None, compat: bool = True) -> dict[str, Column]:
    low = F.lower(c) if low is None else low
    return {
        "decibeis_encontrados": db_values(c),
        "tipo_perda": loss_type(low),
        "lateralidade": ear_side(low, compat),
        "grau_perda": loss_degree(low),
        "srt_db": srt_db(c),
        "iprf_pct": iprf_pct(c),
        "sugestoes_complementares": audio_suggestions(low),
    }


def parse_bera(c: Column, low: Column | None = None, compat: bool = True) -> dict[str, Column]:
    return {"latencias_ms": bera_latencies(c), "limiar_eletrofisiologico_db": bera_threshold(c)}


def parse_ct(c: Column, low: Column | None = None, compat: bool = True) -> dict[str, Column]:
    low = F.lower(c) if low is None else low
    return {"seios_afetados": ct_sinuses(low), "lateralidade": ct_side(low), "achados": ct_findings(low, compat)}


def parse_ct_mastoid(c: Column, low: Column | None = None, compat: bool = True) -> dict[str, Column]:
    low = F.lower(c) if low is None else low
    return {"achados": mastoid_findings(low, compat), "lateralidade": mastoid_side(low, compat)}


def parse_ct_neck(c: Column, low: Column | None = None, compat: bool = True) -> dict[str, Column]:
    low = F.lower(c) if low is None else low
    return {"achados": neck_findings(low), "niveis_cervicais": neck_levels(c)}


def extract_entities(c: Column, exam_type: Column, low: Column | None = None, compat: bool = True) -> Column:
    """Struct of all entity fields; only the parser of the row's exam type is evaluated."""
    low = F.lower(c) if low is None else low
    kind = F.lower(exam_type)
    is_audio = F.contains(kind, F.lit("audiometria"))
    is_bera = ~is_audio & F.contains(kind, F.lit("bera"))
    is_mastoid, is_neck = kind == "tomografia_mastoide", kind == "tomografia_pescoco"
    is_ct = ~is_audio & ~is_bera & ~is_mastoid & ~is_neck & F.contains(kind, F.lit("tomografia"))
    branches = [
        (is_audio, parse_audiometry(c, low, compat)),
        (is_bera, parse_bera(c, low, compat)),
        (is_mastoid, parse_ct_mastoid(c, low, compat)),
        (is_neck, parse_ct_neck(c, low, compat)),
        (is_ct, parse_ct(c, low, compat)),
    ]
    fields = []
    for name, dtype in ENTITY_FIELDS:
        column = F.lit(None).cast(dtype)
        for condition, parsed in reversed(branches):
            if name in parsed:
                column = F.when(condition, parsed[name]).otherwise(column)
        fields.append(column.alias(name))
    return F.struct(*fields)


