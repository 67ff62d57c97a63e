"""Model answers and drifting JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.regex import let

FENCE_PATTERN = r"(?s)\x60{3}json\s*(.*?)\s*\x60{3}"
ANALYSIS_SCHEMA = (
    "is_valid_exam boolean, summary string, findings array<string>, normal_standards string, "
    "diagnostics array<string>, succinct_insight string, error string, _bad string"
)


def strip_code_fence(c: Column) -> Column:
    """JSON inside a Markdown fence; NULL when there is no fence."""
    return let(F.regexp_extract(c, FENCE_PATTERN, 1), lambda v: F.when(v != "", v))


def parse_llm_output(c: Column) -> Column:
    """Typed answer with its defaults; ``error`` is set when the answer is missing, no JSON object, or lacks a field that
    has no default (``summary``, ``findings``, ``diagnostics``). An answer in error is not marked invalid."""
    parsed = F.from_json(
        c, ANALYSIS_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    )
    empty = F.array().cast("array<string>")

    def fill(p: Column) -> Column:
        broken = p.isNull() | p["_bad"].isNotNull()
        lacking = p["summary"].isNull() | p["findings"].isNull() | p["diagnostics"].isNull()
        error = (
            F.when(c.isNull(), F.lit("no answer"))
            .when(broken, F.lit("unreadable answer"))
            .when(p["error"].isNotNull(), p["error"])
            .when(lacking, F.lit("missing field"))
        )
        valid = F.when(lacking, F.lit(True)).otherwise(F.coalesce(p["is_valid_exam"], F.lit(True)))
        return F.struct(
            F.coalesce(valid, F.lit(True)).alias("is_valid_exam"),
            p["summary"].alias("summary"),
            F.coalesce(p["findings"], empty).alias("findings"),
            p["normal_standards"].alias("normal_standards"),
            F.coalesce(p["diagnostics"], empty).alias("diagnostics"),
            F.coalesce(p["succinct_insight"], F.lit("")).alias("succinct_insight"),
            error.alias("error"),
        )

    return let(parsed, fill)


def first_number(c: Column) -> Column:
    """First whole number in a text as INT, NULL if there is none."""
    return F.regexp_extract(c, r"(\d+)", 1).try_cast("int")


def normalize_cases(df: DataFrame, answer: str = "answer") -> DataFrame:
    """Recorded audiometry answers as typed columns; names and insurance are left out.

    The documents drift (numbers as text, an opinion per ear or one for both), so each value is read by
    its path and cast afterwards. The document is parsed once, into a VARIANT.
    """
    doc = F.try_parse_json(strip_code_fence(F.col(answer)))

    def at(path: str) -> Column:
        return F.try_variant_get(F.col("__doc"), path, "string")

    sex = F.lower(F.left(at("$.dados_demograficos.sexo"), F.lit(1)))
    opinion_kind = F.try_variant_get(F.col("__doc"), "$.parecer_audiologico.od", "string")
    return (
        df.withColumn("__doc", doc)
        .select(
            *[c for c in df.columns if c != answer],
            F.when(sex == "m", F.lit("Masculino")).when(sex == "f", F.lit("Feminino")).alias("sexo"),
            first_number(at("$.dados_demograficos.idade")).alias("idade_anos"),
            at("$.dados_demograficos.data_exame").alias("data_exame"),
            F.when(opinion_kind.isNull(), at("$.parecer_audiologico")).alias("parecer"),
            at("$.parecer_audiologico.od").alias("parecer_od"),
            at("$.parecer_audiologico.oe").alias("parecer_oe"),
            first_number(at("$.valores_exame.LRF_OD")).alias("lrf_od_db"),
            first_number(at("$.valores_exame.LRF_OE")).alias("lrf_oe_db"),
            first_number(at("$.valores_exame.IPRF_OD")).alias("iprf_od_pct"),
            first_number(at("$.valores_exame.IPRF_OE")).alias("iprf_oe_pct"),
            at("$.valores_exame.timpanometria_OD").alias("timpanometria_od"),
            at("$.valores_exame.timpanometria_OE").alias("timpanometria_oe"),
        )
    )


def nesting(json: Column) -> Column:
    """How deep objects and arrays are nested in a JSON text."""
    without_texts = F.regexp_replace(json, r'"(?:[^"\\]|\\.)*+"', "")
    brackets = F.filter(F.split(F.regexp_replace(without_texts, r"[^\[\]{}]", ""), ""), lambda c: c != "")

    def step(acc: Column, c: Column) -> Column:
        now = acc["now"] + F.when(c.isin("{", "["), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.aggregate(brackets, start, step, lambda acc: acc["most"])


def answer_schema(df: DataFrame, answer: str = "answer") -> str | None:
    """The schema into which those of all readable answers merge, as text; NULL when none is readable."""
    doc = F.try_parse_json(strip_code_fence(F.col(answer)))
    return df.agg(F.schema_of_variant_agg(doc)).first()[0]


def drift_report(df: DataFrame, answer: str = "answer") -> DataFrame:
    """``(path, kind, documents)``: in how many answers each path of the JSON documents holds each kind of value.

    The path of the document is ``$``; ``[]`` stands for any element of an array. An answer without a fence is counted
    under ``$`` as ``absent``, one whose fence holds no JSON as ``unreadable``. One pass finds how deep documents go; a
    document is then walked level by level inside its row, and only its distinct (path, kind) pairs leave it, to be
    counted with partial counts per task. ``answer_schema`` has the same documents as one merged schema.
    """
    levels = df.select(F.max(nesting(strip_code_fence(F.col(answer))))).first()[0] or 0
    nodes = "array<struct<path: string, v: variant>>"

    def children(n: Column) -> Column:
        fields = F.map_entries(F.try_variant_get(n["v"], "$", "map<string, variant>"))
        items = F.try_variant_get(n["v"], "$", "array<variant>")
        inner = F.transform(fields, lambda e: F.struct(F.concat(n["path"], F.lit("."), e["key"]).alias("path"), e["value"].alias("v")))
        elements = F.transform(items, lambda x: F.struct(F.concat(n["path"], F.lit("[]")).alias("path"), x.alias("v")))
        return F.coalesce(inner, elements, F.array().cast(nodes))

    rows = df.select(strip_code_fence(F.col(answer)).alias("__json"))
    rows = rows.select("__json", F.try_parse_json("__json").alias("__doc"))
    rows = rows.withColumn("__level0", F.when(F.col("__doc").isNotNull(), F.array(F.struct(F.lit("$").alias("path"), F.col("__doc").alias("v")))))
    for i in range(levels):
        rows = rows.withColumn(f"__level{i + 1}", F.flatten(F.transform(f"__level{i}", children)))
    every = F.concat(*[F.col(f"__level{i}") for i in range(levels + 1)])
    kind = lambda v: F.lower(F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0))
    names = {"bigint": "number", "decimal": "number", "double": "number", "float": "number", "void": "null"}
    named = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    found = F.array_distinct(F.transform(every, lambda n: F.struct(n["path"].alias("path"), kind(n["v"]).alias("kind"))))
    missing = F.when(F.col("__json").isNull(), F.lit("absent")).otherwise(F.lit("unreadable"))
    pairs = rows.select(F.explode(F.coalesce(found, F.array(F.struct(F.lit("$").alias("path"), missing.alias("kind"))))).alias("p"))
    merged = F.coalesce(F.try_element_at(named, F.col("p.kind")), F.col("p.kind"))
    counts = pairs.select("p.path", merged.alias("kind")).groupBy("path", "kind")
    return counts.agg(F.count("*").alias("documents"))
