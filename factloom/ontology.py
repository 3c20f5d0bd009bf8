"""Labels, layers, relation rules and word lists of the document graph, as small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The labels of each layer.
LAYERS = {
    "L1": "Material Process Equipment ChemicalReagent StandardMetric PhaseState Property".split(),
    "L2": "Document Expert Location Organization Event Timeline Facility".split(),
    "L3": "TextParagraph TableMatrix HeadingContext LangContext SynonymMap".split(),
    "L4": "ExperimentRun TechStage Measurement Deviation TrendVector Formula EnvironmentalCondition Effect Claim".split(),
    "L5": "VerificationStatus SecurityRole Contradiction AuditTrail KnowledgeGap".split(),
    "L6": "TechnologySolution EconomicIndicator EnvironmentalIndicator".split(),
}
#: Relation types that may link which labels.
_L1, _L2, _L6 = LAYERS["L1"], LAYERS["L2"], LAYERS["L6"]
_RUN, _TEXT = ["TechStage", "ExperimentRun"], ["TextParagraph", "TableMatrix"]
REL_RULES = {
    "IN_PHASE": (["Material"], ["PhaseState"]),
    "HAS_PROPERTY": (["Material", "Process"], ["Property"]),
    "AUTHORED": (["Expert"], ["Document"]),
    "ISSUED_AT": (["Document"], ["Location"]),
    "BELONGS_TO": (["Document"], ["Organization"]),
    "HAS_EVENT": (["Document"], ["Event"]),
    "ON_TIMELINE": (["Event", "Document"], ["Timeline"]),
    "HAS_PARAGRAPH": (["Document"], ["TextParagraph"]),
    "HAS_TABLE": (["Document"], ["TableMatrix"]),
    "HAS_HEADER": (["Document"], ["HeadingContext"]),
    "HAS_LANG": (["Document"], ["LangContext"]),
    "NEXT_PARAGRAPH": (["TextParagraph"], ["TextParagraph"]),
    "STRUCTURING": (["HeadingContext"], ["TextParagraph"]),
    "MAPS_TO": (["SynonymMap"], _L1),
    "TAGGED_WITH": (["TextParagraph"], ["LangContext"]),
    "CONTEXT_FOR": (_TEXT, [*_L2, "ExperimentRun", "TechStage", "Measurement", "Effect", "Claim", "VerificationStatus", "SecurityRole"]),
    "DATA_SOURCE_FOR": (_TEXT, [*_L1, "Measurement", "ExperimentRun", "TechStage", "Effect", "Claim", "Formula", "Deviation"]),
    "ABOUT": (_TEXT, _L6),
    "CONDUCTED_AT": (["ExperimentRun"], ["Facility"]),
    "EXECUTES_STAGE": (["ExperimentRun"], ["TechStage"]),
    "PRODUCED_MEASURE": (_RUN, ["Measurement"]),
    "TRIGGERED_DEV": (_RUN, ["Deviation"]),
    "COMPUTED_BY": (["Measurement"], ["Formula"]),
    "HAS_TREND": (["Measurement"], ["TrendVector"]),
    "USES_MAT": (_RUN, ["Material"]),
    "OPERATES_PROC": (_RUN, ["Process"]),
    "IN_EQUIPMENT": (_RUN, ["Equipment"]),
    "CONSUMES_REAGENT": (_RUN, ["ChemicalReagent"]),
    "EVALUATED_AGAINST": (["Measurement"], ["StandardMetric"]),
    "PRODUCES_OUTPUT": (_RUN, ["Material"]),
    "SHOWED_EFFECT": (_RUN, ["Effect"]),
    "UNDER_CONDITIONS": (["ExperimentRun"], ["EnvironmentalCondition"]),
    "PREVIOUS_VERSION": (["Measurement"], ["Measurement"]),
    "ASSERTED_BY": (["Claim"], ["Document", "Expert", "ExperimentRun", "TechStage", "Organization"]),
    "DERIVED_FROM": (["Claim"], ["TextParagraph", "TableMatrix", "Measurement", "Claim", "ExperimentRun"]),
    "HAS_OBJECT": (["Claim"], [*_L1, "ExperimentRun", "TechStage", "Measurement", "Effect", "TechnologySolution"]),
    "HAS_VALIDATION": (["ExperimentRun"], ["VerificationStatus"]),
    "FOUND_ANOMALY": (["Measurement"], ["Contradiction"]),
    "BASE_FOR_CONFLICT": (["StandardMetric"], ["Contradiction"]),
    "GOVERNED_BY": (["Document"], ["SecurityRole"]),
    "WRITES_LOG": (["VerificationStatus"], ["AuditTrail"]),
    "RESOLVED_BY": (["Contradiction"], ["Expert"]),
    "FIXED_IN": (["Contradiction"], ["Document"]),
    "LINKED_GAP": (["Contradiction"], ["KnowledgeGap"]),
    "DETECTED_MISSING": (["Process", "Material"], ["KnowledgeGap"]),
    "DESCRIBES_SOLUTION": (["TechnologySolution"], ["Process"]),
    "USES_MATERIAL_TS": (["TechnologySolution"], ["Material"]),
    "HAS_ECONOMIC_INDICATOR": (["TechnologySolution"], ["EconomicIndicator"]),
    "HAS_ENVIRONMENTAL_INDICATOR": (["TechnologySolution"], ["EnvironmentalIndicator"]),
    "SOURCE": (["TechnologySolution"], ["Document"]),
    "COMPARABLE_TO": (["TechnologySolution"], ["TechnologySolution"]),
}
#: Other names of relation types.
REL_ALIASES = {"DESCRIBES_PROC": "DESCRIBES_SOLUTION", "DESCRIBES": "DESCRIBES_SOLUTION", "HAS_ECONOMIC": "HAS_ECONOMIC_INDICATOR", "HAS_ENVIRONMENTAL": "HAS_ENVIRONMENTAL_INDICATOR", "HAS_HEADING": "HAS_HEADER", "PRODUCED_MEASUREMENT": "PRODUCED_MEASURE", "SHOWS_EFFECT": "SHOWED_EFFECT", "HAS_EFFECT": "SHOWED_EFFECT"}
#: What relation types mean.
REL_TEXTS = {
    "STRUCTURING": "Заголовок раздела структурирует абзац текста (иерархия документа L3).",
    "TAGGED_WITH": "Абзац помечен языковым или типографским контекстом.",
    "NEXT_PARAGRAPH": "Последовательный переход к следующему абзацу в тексте.",
    "HAS_PARAGRAPH": "Документ содержит абзац текста.",
    "HAS_TABLE": "Документ содержит таблицу.",
    "HAS_HEADER": "Документ содержит заголовок раздела.",
    "HAS_LANG": "Документ связан с языковым контекстом.",
    "CONTEXT_FOR": "Текст или таблица даёт контекст для сущности другого слоя.",
    "DATA_SOURCE_FOR": "Фрагмент текста — источник данных для факта или измерения.",
    "ABOUT": "Фрагмент текста описывает технологическое решение (L6).",
    "WRITES_LOG": "Статус верификации фиксируется в журнале аудита (L5).",
    "GOVERNED_BY": "Документ регулируется ролью безопасности.",
    "USES_MAT": "Стадия или опыт использует материал.",
    "PRODUCED_MEASURE": "Стадия или опыт породил измерение.",
    "SHOWED_EFFECT": "Эксперимент или стадия показала эффект.",
    "DERIVED_FROM": "Утверждение (Claim) выведено из источника.",
    "ASSERTED_BY": "Утверждение сделано экспертом, документом или организацией.",
}
#: Classification levels, their other names, and the levels that each role may read.
LEVELS = ["открытый", "внутренний", "конфиденциальный", "строго"]
LEVEL_ALIASES = {"public": "открытый", "open": "открытый", "internal": "внутренний", "confidential": "конфиденциальный", "restricted": "строго", "strict": "строго"}
ROLES = {"admin": LEVELS, "viewer": LEVELS[:1], "researcher": LEVELS[:2], "analyst": LEVELS[:2], "engineer": LEVELS[:2], "validator": LEVELS[:2], "security": LEVELS}
#: Placeholder words that stand for no value.
PLACEHOLDERS = ["", "-", "—", "?", "n/a", "na", "none", "null", "nil", "unknown", "unspecified", "not specified", "not available", "tbd", "<id>", "<value>", "нет", "нет данных", "не указано", "не указан", "не определено", "неизвестно", "отсутствует"]
#: File extensions and how each is read.
ROUTES = {"pdf": "ocr", "png": "ocr", "jpg": "ocr", "jpeg": "ocr", "webp": "ocr", "bmp": "ocr", "tiff": "ocr", "tif": "ocr", "md": "markdown", "txt": "text", "csv": "csv", "json": "json", "yaml": "yaml", "yml": "yaml", "xml": "xml", "docx": "docx", "xlsx": "xlsx"}


def labels(spark: SparkSession) -> DataFrame:
    """label, layer."""
    return spark.createDataFrame([(x, k) for k, xs in LAYERS.items() for x in xs], "label string, layer string")


def relation_rules(spark: SparkSession) -> DataFrame:
    """type, from_label, to_label."""
    return spark.createDataFrame([(t, a, b) for t, (xs, ys) in REL_RULES.items() for a in xs for b in ys], "type string, from_label string, to_label string")


def relation_texts() -> dict[str, str]:
    """What each relation type means: its text, or the labels that it links."""
    return {t: f"Связь {t}: {', '.join(sorted(a))} → {', '.join(sorted(b))}" for t, (a, b) in REL_RULES.items()} | REL_TEXTS


def relation_aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(REL_ALIASES.items()), "alias string, canonical string")


def role_access(spark: SparkSession) -> DataFrame:
    """role, level."""
    return spark.createDataFrame([(r, x) for r, xs in ROLES.items() for x in xs], "role string, level string")


def values_sql(rows: dict[str, str] | list[tuple[str, ...]]) -> str:
    """The rows as a VALUES list, for oracles."""
    items = rows.items() if isinstance(rows, dict) else rows
    return "VALUES " + ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in r) + ")" for r in items)
