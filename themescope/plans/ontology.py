"""The ontology of themes: a dimension table with a fixed order, compiled into columns at plan time.

The order of themes, kinds and terms is part of the meaning: it fixes the first match, the order of additions and
all ties. Terms are matched in lower case as raw substrings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Themes in order, and for each its keywords, scientific and artistic phrases in order.
THEMES = {
    "COMP": {
        "keyword": ["алгоритм", "вычисление", "процессор", "программа", "код", "input", "output", "обработка", "computation", "function", "символ", "репрезентация", "информация"],
        "scientific": ["мозг как компьютер", "сознание как программное обеспечение", "разум как машина Тьюринга", "мышление как вычисление"],
        "artistic": ["данные как материал", "алгоритм как художник", "код как язык искусства", "нейросеть как сознание"],
    },
    "IIT": {
        "keyword": ["интеграция", "целостность", "несводимость", "phi", "квалиа", "integration", "irreducibility", "quale", "субъективность", "внутренняя перспектива", "феноменальное"],
        "scientific": ["сознание как интегрированная информация", "опыт как неделимое целое", "phi как мера сознания"],
        "artistic": ["единство противоположностей", "неделимый образ", "целое больше суммы частей", "интегрированное восприятие"],
    },
    "PRED": {
        "keyword": ["предсказание", "прогноз", "ошибка", "байесовский", "prior", "prediction", "error", "bayesian", "free energy", "минимизация", "неопределённость", "вероятность", "модель мира"],
        "scientific": ["мозг как байесовский предсказатель", "сознание как минимизация свободной энергии", "восприятие как контролируемая галлюцинация"],
        "artistic": ["ожидание vs реальность", "генеративные модели как творчество", "предвосхищение образа", "синтез восприятия"],
    },
    "GWT": {
        "keyword": ["внимание", "рабочее пространство", "broadcast", "театр", "spotlight", "awareness", "доступ", "глобальный", "конкуренция", "селекция", "фокус"],
        "scientific": ["сознание как театр разума", "внимание как прожектор", "осознание как трансляция информации"],
        "artistic": ["сцена восприятия", "фокус внимания", "выбор образа", "освещение смысла"],
    },
    "ENACT": {
        "keyword": ["телесность", "воплощение", "действие", "сенсомоторный", "embodied", "enacted", "sensorimotor", "петля", "взаимодействие", "среда", "coupling", "движение"],
        "scientific": ["познание как действие", "разум как воплощённый процесс", "сознание через телесность"],
        "artistic": ["тело как медиум", "жест как мысль", "движение как познание", "материальность разума"],
    },
    "PAN": {
        "keyword": ["протоопыт", "панпсихизм", "одушевление", "всеобщность", "protophenomenal", "panpsychism", "универсальность", "материя чувствует", "внутренняя жизнь", "анимизм"],
        "scientific": ["материя как чувствующая", "протоквалиа в элементах", "сознание как фундаментальное свойство"],
        "artistic": ["живая материя", "одушевлённые объекты", "чувствующие системы", "агентность материала"],
    },
    "EMERG": {
        "keyword": ["эмерджентность", "самоорганизация", "сложность", "рой", "emergence", "self-organization", "swarm", "collective", "фазовый переход", "новое качество", "синергия"],
        "scientific": ["сознание как эмерджентное свойство", "разум как самоорганизующаяся система", "коллективный интеллект"],
        "artistic": ["роевой разум", "коллективное творчество", "спонтанный порядок", "множественность в единстве"],
    },
}
# Markers of a type; the first list is searched in the text, the others in the span.
MARKERS = {
    "ontological": ["сознание", "разум", "мышление", "познание", "опыт", "consciousness", "mind", "thinking", "cognition", "experience", "субъективность", "квалиа", "осознание", "awareness", "природа", "сущность", "механизм", "nature", "essence"],
    "structural": ["архитектура", "структура", "слои", "уровни", "модули", "architecture", "structure", "layers", "levels", "modules", "организация", "иерархия", "система", "organization"],
    "orientational": ["внутри", "снаружи", "верх", "низ", "глубина", "поверхность", "inside", "outside", "up", "down", "depth", "surface", "центр", "периферия", "пространство", "время"],
}
# Weights by level and type, the score of a term by kind, and thresholds.
LEVEL_WEIGHTS = {"explicit_term": 1.0, "scientific_metaphor": 0.7, "meta_metaphor": 0.8, "nested_metaphor": 0.5}
TYPE_WEIGHTS = {"ontological": 1.2, "structural": 1.0, "orientational": 0.8, "decorative": 0.3}
KIND_SCORES = {"keyword": 0.15, "scientific": 0.3, "artistic": 0.5}
LEVEL_OF_KIND = {"keyword": "explicit_term", "scientific": "scientific_metaphor", "artistic": "meta_metaphor"}
LEAST_SCORE, HYBRID_WEIGHT = 0.2, 0.5


@dataclass(frozen=True)
class Term:
    theme: str
    theme_ord: int
    kind: str
    term_ord: int
    term: str

    @property
    def words(self) -> list[str]:
        return self.term.lower().split()


@dataclass(frozen=True)
class Ontology:
    terms: tuple[Term, ...]
    markers: tuple[tuple[str, tuple[str, ...]], ...]

    @property
    def themes(self) -> list[str]:
        return list(dict.fromkeys(t.theme for t in self.terms))

    def of(self, theme: str, kind: str) -> list[Term]:
        return [t for t in self.terms if t.theme == theme and t.kind == kind]

    def marker(self, kind: str) -> tuple[str, ...]:
        return dict(self.markers)[kind]


def ontology(themes: dict[str, dict[str, list[str]]], markers: dict[str, list[str]] = MARKERS) -> Ontology:
    """An ontology from nested lists; empty terms are an error, since they would match everything."""
    terms = tuple(Term(theme, k, kind, i, term) for k, (theme, kinds) in enumerate(themes.items()) for kind in KIND_SCORES for i, term in enumerate(kinds.get(kind, [])))
    if any(not t.words for t in terms):
        raise ValueError("a term is empty")
    return Ontology(terms, tuple((k, tuple(v)) for k, v in markers.items()))


SHIPPED = ontology(THEMES)

#: A stand-in of the same shape, whose terms do occur in the synthetic documents; for queries over volume.
PROXY = ontology(
    {
        "ALPHA": {"keyword": ["thand", "edoue", "ofth", "eaner", "tionou"], "scientific": ["thean onst heedre", "andre inwh"], "artistic": ["therhe ingou", "bleat ore asnt"]},
        "BETA": {"keyword": ["queion", "réeau", "mentle", "aireen"], "scientific": ["eauou treé", "lareen ouvi desle"], "artistic": ["éonre aiier", "pale tion"]},
        "GAMMA": {"keyword": ["ciónar", "quedo", "esadob"], "scientific": ["mente ción quez", "osla aras"], "artistic": ["dollco asta", "ñes taes"]},
        "DELTA": {"keyword": ["ungver", "keitsch", "lichbe"], "scientific": ["heitge erung", "enstver"], "artistic": ["chbe ungen", "zuie erei auß"]},
        "OMEGA": {"keyword": ["license", "example.com", "password"], "scientific": ["mit license", "the rights reserved"], "artistic": ["mail password", "by error"]},
    },
    {"ontological": ["this is", " que est ", " ist ein"], "structural": ["onst", "ción", "ung"], "orientational": ["ou", "er"]},
)


def dimension(spark: SparkSession, o: Ontology = SHIPPED) -> DataFrame:
    """(theory, theory_ord, kind, term_ord, term, words): one row a term."""
    rows = [(t.theme, t.theme_ord, t.kind, t.term_ord, t.term, t.words) for t in o.terms]
    return spark.createDataFrame(rows, "theory string, theory_ord int, kind string, term_ord int, term string, words array<string>")
