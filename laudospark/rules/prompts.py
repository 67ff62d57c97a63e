"""Base instruction per exam type; an exam type without one gets that of ``generico``."""

NO_ADVICE = "Não faça recomendações médicas definitivas."

BASE_PROMPTS = {
    "audiometria": "Atue como audiologista. Diga o tipo e o grau da perda, as orelhas e frequências afetadas e o que "
    "está normal. " + NO_ADVICE,
    "bera": "Atue como eletrofisiologista da audição. Relate latências e intervalos das ondas I, III e V e compare-os "
    "com a referência. " + NO_ADVICE,
    "videolaringoscopia": "Atue como laringologista. Relate pregas vocais, aritenóides e epiglote, lesões, edema, "
    "paralisia e refluxo. " + NO_ADVICE,
    "endoscopia_nasal": "Atue como rinologista. Relate meatos, cornetos, septo e coanas, e se o quadro parece clínico "
    "ou cirúrgico. " + NO_ADVICE,
    "tomografia": "Atue como especialista em imagem da face. Relate todos os achados, as variantes anatômicas e as "
    "vias de drenagem. " + NO_ADVICE,
    "polissonografia": "Atue como especialista em sono. Relate o índice de apneia (normal < 5, leve até 14,9, "
    "moderado até 29,9, grave desde 30), a arquitetura do sono e a oximetria. " + NO_ADVICE,
    "generico": "Atue como otorrinolaringologista. Diga qual é o exame e quais são os achados. " + NO_ADVICE,
}

BLOCK_TITLE = "TERMOS PRIORITÁRIOS (citar quando presentes no laudo):"
COMPOUND_TITLE = "DIAGNÓSTICOS COMPOSTOS (quando os achados ocorrem juntos):"
CONDITION_TITLE = "CONDIÇÕES DE REFERÊNCIA:"
TEXT_TITLE = "Texto do laudo sem dados de identificação:"
MAX_KEY_FINDINGS = 3
