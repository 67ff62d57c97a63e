import hashlib

import pytest
from pyspark.sql import functions as F

from laudospark.functions import redact as P
from laudospark.rules import patterns as R


def tag(name):
    return f"[Paciente_{hashlib.sha256(name.encode()).hexdigest()[:6].upper()}]"


def test_strip_pii(one):
    raw = "Paciente: Joao da Silva\nCPF: 123.456.789-00\nRG: 12.345.678-9\ncrm 12345-SP"
    out = one(raw, P.strip_pii)
    assert out == f"Paciente: {tag('Joao da Silva')}\nCPF: [CPF OMITIDO]\nRG: [RG OMITIDO]\n[MÉDICO OMITIDO]"
    assert one(None, P.strip_pii) == ""


def test_every_name_gets_its_own_pseudonym(one):
    raw = "Nome: Ana Lima\nx\nPACIENTE...: Ana Lima Souza   cpf: 1\nnome Rui\n"
    expected = f"Nome {tag('Ana Lima')}\nx\nPACIENTE...: {tag('Ana Lima Souza')}   cpf: 1\nnome {tag('Rui')}\n"
    assert one(raw, P.strip_pii) == expected


def test_names_in_a_text_with_fence_characters(one):
    raw = f"{P.FENCE}Nome: Ana Lima\n{P.INNER}z nome: Rui"
    assert one(raw, P.strip_pii) == f"{P.FENCE}Nome {tag('Ana Lima')}\n{P.INNER}z nome {tag('Rui')}"


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("Curva plana em ambas\nLimiar 30 dB\nfim. x", "Curva plana: [OMITIDO]\nfim. x"),
        ("CRM 1234567-8 RJ / CRM-RJ:7654321 / crm 12345-SP", "[MÉDICO OMITIDO]8 RJ / CRM-RJ:7654321 / [MÉDICO OMITIDO]"),
        ("nascimento: 01/02/1990 01-02-1990", "nascimento: [DATA OMITIDA] 01-02-1990"),
        ("N° pedido: 77 A\nx", "N° pedido: [OMITIDO]\nx"),
        ("12345678901 e 1234567890", "[CPF OMITIDO] e 1234567890"),
    ],
)
def test_quirks(one, raw, expected):
    assert one(raw, P.strip_pii) == expected


def test_mended_rules(one):
    def fixed(c):
        return P.strip_pii(c, R.PII_RULES_FIXED)

    assert one("Curva plana em ambas\nLimiar 30 dB", fixed) == "Curva plana em ambas\nLimiar 30 dB"
    assert one("CRM 1234567-8 RJ / CRM-RJ:7654321.", fixed) == "[MÉDICO OMITIDO] / [MÉDICO OMITIDO]."
    assert one("Plano: Ouro 7\nx", fixed) == "Plano: [OMITIDO]\nx"


def test_redaction_is_idempotent_for_cpf_and_crm(one):
    raw = "CPF 123.456.789-00 crm 12345-SP"
    once = one(raw, P.strip_pii)
    assert one(once, P.strip_pii) == once


def test_counts(spark):
    df = spark.createDataFrame([("a.b@x.com 10.0.0.1 +1 (499) 555-6503 1234567812345678 c@d.org",)], "t string")
    row = df.select(*P.pii_counts(F.col("t"), R.GENERIC_PII_RULES)).first()
    assert row.asDict() == {"n_email": 2, "n_ip": 1, "n_phone": 1, "n_card": 1}


@pytest.mark.parametrize(
    "raw, expected, count",
    [
        ("anna@a.com-bob@b.org", "[EMAIL OMITIDO][EMAIL OMITIDO]", 2),
        ("a@b.com.c@d.org", "[EMAIL OMITIDO][EMAIL OMITIDO]", 2),
        ("x ana@a.com%20bob@b.org y", "x [EMAIL OMITIDO][EMAIL OMITIDO] y", 2),
        ("a@b.com_c@d.org+e@f.net", "[EMAIL OMITIDO][EMAIL OMITIDO][EMAIL OMITIDO]", 3),
        ("a@b.com-- c@d", "[EMAIL OMITIDO]-- c@d", 1),
        ("%+-@x.y a.b@c.de", "%+-@x.y [EMAIL OMITIDO]", 1),
    ],
)
def test_joined_addresses(one, raw, expected, count):
    assert one(raw, lambda c: P.strip_pii(c, R.GENERIC_PII_RULES), lambda c: P.pii_counts(c, R.GENERIC_PII_RULES)[0]) == (expected, count)
