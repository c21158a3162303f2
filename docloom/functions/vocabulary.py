"""Vocabularies of the rule operators, and their override by configuration."""

from __future__ import annotations

import json
import warnings
from collections.abc import Mapping
from dataclasses import dataclass, field

# The word lists that rules, scores and categories are defined by.
STOP_WORDS = tuple("и в во на с со что как для по из к ко о об от до у не это а или ли про сказано говорится вопрос корпусе".split())
STEM_SUFFIXES = tuple(
    "иями ями ами его ого ему ому ыми ими иях ах ях иям ям ием ем ам ом ев ов ие ые ое ей ий ый ой ым им ую юю ая яя ою ею ия ья ью ию ых их а я ы и е о у ю".split()
)
TOC_TITLES = ("содержание", "оглавление", "table of contents")
STANDALONE_TITLES = (*TOC_TITLES, "аннатация", "аннатоция", "аннотация", "введение", "заключение", "приложение", "references", "introduction", "conclusion")
SERVICE_TABLE_TERMS = (
    "утверждаю", "утверждено", "согласовано", "согласовал", "разработал", "проверил", "подпись", "должность", "коммерческий директор", "ф.и.о", "фио",
    "(число)", "(месяц)",
)
REQUIREMENT_TERMS = {
    "prohibition": ("запрещается", "не допускается", "допускается только"),
    "obligation": (
        "должен", "должна", "должно", "должны", "обязан", "обязана", "обязано", "обязаны", "необходимо", "требуется", "следует", "подлежит",
        "подлежат", "устанавливается",
    ),
    "threshold_or_limit": ("предельно допустим", "пдв", "пдк", "ндв", "норматив", "лимит"),
    "monitoring_or_control": ("контроль", "мониторинг", "проводится", "осуществляется"),
    "calculation_or_reporting": ("расчет", "расчёт", "отчет", "отчёт", "декларация", "представляется"),
}
REQUIREMENT_SCORES = {"prohibition": 0.72, "obligation": 0.68, "threshold_or_limit": 0.62, "monitoring_or_control": 0.48, "calculation_or_reporting": 0.5}
DOMAIN_HINTS = ("норматив", "предельно допустим", "пдв", "пдк", "ндв", "лимит", "расчет", "расчёт", "контроль", "мониторинг")
TABLE_TERMS = {
    "emissions": ("выброс", "пдв", "ндв", "г/с", "т/год"),
    "pollutants": ("вещество", "загрязняющее вещество", "код"),
    "limits_or_norms": ("пдк", "пдв", "ндв", "норматив", "лимит", "разрешение", "доля пдк"),
    "measurements": ("концентрация", "мг/м3", "мг/м³", "контроль", "мониторинг", "замер", "периодичность"),
    "costs_or_resources": ("расход", "сырье", "сырьё", "материал", "затраты"),
    "sources_or_equipment": ("источник", "источник выбросов", "оборудование", "газоочистка"),
}
SECTION_TABLE_HINTS = ("расчет", "расчёт", "таблиц")
TABLE_LIKE_TERMS = ("таблиц", "строка", "колонка", "столбец", "графа", "table", "row", "column")
PLACEHOLDERS = ("-", "—", "n/a", "na", "none", "null", "нет", "не указан", "не указано", "отсутствует")
DOCUMENT_EXTENSIONS = ("pdf", "docx", "doc", "rtf", "txt", "xlsx", "xls", "jpeg", "jpg", "png", "heic", "heif", "tiff", "tif", "bmp", "webp")
SUPPORTED_SUFFIXES = (".pdf", ".doc", ".docx", ".rtf", ".txt", ".xls", ".xlsx", ".jpg", ".jpeg", ".png")
KNOWN_IMAGE_SUFFIXES = (".heic", ".heif", ".tif", ".tiff", ".bmp", ".webp")


@dataclass(frozen=True)
class Rules:
    """Category vocabularies in force, in order of category."""

    requirements: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: dict(REQUIREMENT_TERMS))
    tables: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: dict(TABLE_TERMS))

    def extended(self, config: Mapping) -> Rules:
        """These rules with a section's ``category_terms`` replaced and ``additional_category_terms`` appended.

        Unknown categories and malformed sections are warned about and leave the section as it was.
        """
        sections = {}
        for name, now in (("requirements", self.requirements), ("tables", self.tables)):
            own = config.get(name, {})
            try:
                terms = {k: tuple(v) for k, v in now.items()}
                for key, append in (("category_terms", False), ("additional_category_terms", True)):
                    for category, values in dict(own.get(key, {})).items():
                        if category not in terms or not isinstance(values, list) or not all(isinstance(v, str) and v.strip() for v in values):
                            raise ValueError(f"{name}.{key}.{category}")
                        base = terms[category] if append else ()
                        terms[category] = tuple(dict.fromkeys((*base, *(v.strip() for v in values))))
                sections[name] = terms
            except (AttributeError, TypeError, ValueError) as e:
                warnings.warn(f"rules ignored: {e}", RuntimeWarning, stacklevel=2)
                sections[name] = dict(now)
        return Rules(**sections)

    @classmethod
    def load(cls, path: str | None) -> Rules:
        """Rules from a JSON file; without one, or where it can't be read, the defaults."""
        if not path:
            return cls()
        try:
            with open(path, encoding="utf-8") as f:
                config = json.load(f)
        except (OSError, ValueError) as e:
            warnings.warn(f"rules ignored: {e}", RuntimeWarning, stacklevel=2)
            return cls()
        return cls().extended(config if isinstance(config, dict) else {})
