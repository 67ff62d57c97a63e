import pytest
from pyspark.sql import functions as F

from laudospark.functions import header as H

HEADER = "Paciente: Rita Moura\nNascimento: 02/11/1975\nIdade: 48 anos\nSexo: Feminino\nCargo: Soldadora"


def split(spark, text):
    row = H.split_header(spark.createDataFrame([(text,)], "text string")).first()
    return row.header, row.body


@pytest.mark.parametrize(
    "text, header, body",
    [
        (
            "Nome: Beatriz Souto\nConvênio: Azul\nIndicação Clínica: tosse.\nAchados: sem alterações",
            "Nome: Beatriz Souto\nConvênio: Azul",
            "Indicação Clínica: tosse.\nAchados: sem alterações",
        ),
        ("LAUDO curto", "", "LAUDO curto"),
        ("a\nb\nc\nd\ne\nf", "a\nb\nc\nd\ne", "a\nb\nc\nd\ne\nf"),
        ("a\r\n  Exame: tc\r\nfim\r\n", "a", "  Exame: tc\nfim"),
        ("a\nb\r\nc\n", "a\nb\nc", "a\nb\r\nc\n"),
        ("um\n\nachados\n", "um\n", "achados"),
        ("tcx\nTC de face\nz", "tcx", "TC de face\nz"),
        ("indicação\nclínica\nlaudo", "indicação\nclínica", "laudo"),
        ("sem achados\nqueixa principal", "sem achados", "queixa principal"),
        ("a\n" + " " * 30000 + "achados b", "a", " " * 30000 + "achados b"),
        ("a\n \x1f Laudo", "a", " \x1f Laudo"),
        (" " * 30000 + "x\ny", " " * 30000 + "x\ny", " " * 30000 + "x\ny"),
        ("", "", ""),
        (None, "", ""),
        ("\n", "", "\n"),
    ],
)
def test_split_header(spark, text, header, body):
    assert split(spark, text) == (header, body)


def test_split_keeps_every_line_of_a_long_report(spark):
    lines = [f"linha {i} 😀" for i in range(20000)]
    lines[15000] = "Achados: x"
    header, body = split(spark, "\n".join(lines))
    assert header.split("\n") == lines[:15000] and body.split("\n") == lines[15000:]


@pytest.mark.parametrize(
    "header, expected",
    [
        ("Paciente: Rui\nData do Exame: 07/08/2023\nExame: bera", "2023-08-07"),
        ("Paciente: Lia\nRealizado em: 2022-12-05", "2022-12-05"),
        ("Data 2021-01-06", "2006-01-21"),
        ("Data: 2021-01-06", "2021-01-06"),
        ("Data do Exame: 11/24/2025", "2025-24-11"),
        ("Data de Nasc: 10/10/1960\nData da Ficha: 02/03/2024", "1960-10-10"),
        ("Data: 1-2/21", "1-2/21"),
        ("EMISSÃO: 1.2.21", "2021-02-01"),
        ("sem data", ""),
    ],
)
def test_exam_date(one, header, expected):
    assert one(header, lambda c: H.exam_date(c, F.lit(""))) == expected


def test_exam_date_mended(one):
    text = "Data de Nasc: 10/10/1960\nData da Ficha: 02/03/2024"
    assert one(text, lambda c: H.exam_date(c, F.lit(""), compat=False)) == "2024-03-02"
    assert one("2025-24-11", H.exam_date_as_date) is None


def test_exam_date_looks_at_the_start_of_the_body_only(one):
    near, far = "x" * 700 + " 01/02/2020", "x" * 800 + " 01/02/2020"
    assert one(near, lambda c: H.exam_date(F.lit(""), c)) == "2020-02-01"
    assert one(far, lambda c: H.exam_date(F.lit(""), c)) == ""


@pytest.mark.parametrize(
    "raw, expected", [("1/2/123", "20123-02-01"), ("2020-1-2", "2020-1-2"), ("2020-1-02", "2020-01-02"), ("1/2-2020", "1/2-2020"), ("9.8.07 x", "2007-08-09")]
)
def test_normalize_date(one, raw, expected):
    assert one(raw, H.normalize_date) == expected


def test_patient_token(one):
    first, again = one(HEADER, H.patient_token, H.patient_token)
    assert first == again and first.startswith("pt-") and len(first) == 15
    random_token, by_id = one("", H.patient_token, lambda c: H.patient_token(c, F.lit(7)))
    assert random_token.startswith("pt-") and len(random_token) == 15
    assert by_id == one("abc", lambda c: H.patient_token(c, F.lit(7)))


def test_patient_data(one):
    assert one(HEADER, H.patient_data).asDict() == {
        "nome": "Rita Moura",
        "data_nascimento": "1975-11-02",
        "idade": "48 anos",
        "sexo": "Feminino",
        "cargo_funcao": "Soldadora",
    }
    assert set(one("", H.patient_data)) == {""}
    assert one("NOME: Ana\nSEXO: f", H.patient_data).sexo == "Feminino"
    assert one("NOME: Ana\nSEXO: f", H.patient_data).nome == ""
    assert one("nome: Zoë D'Ávila   cpf: 1", H.patient_data).nome == "Zoë D'Ávila"
