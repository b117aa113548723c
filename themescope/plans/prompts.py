"""Prompts: the system prompt, the section on levels and types, the hint of the pre-analysis."""

from __future__ import annotations

from themescope.plans.ontology import KIND_SCORES, LEVEL_WEIGHTS, SHIPPED, TYPE_WEIGHTS, Ontology

# Indicators of the plain taxonomy and their weights.
INDICATORS = {"explicit": 1.0, "technical_cue": 0.6, "metaphor": 0.4}
PROMPT = "Classify the description by theme and answer with one JSON object."
#: The section goes before this marker.
MARKER = "ANSWER FORMAT:"


def system_prompt(o: Ontology = SHIPPED) -> str:
    """What a classifier is told once: classes, indicators, the rules that ``responses.contract`` checks, the format."""
    indicators = ", ".join(f"{k} ({w})" for k, w in INDICATORS.items())
    return (
        f"You sort descriptions of art works by theme. Classes: {', '.join(o.themes)}, and UND if none applies. Indicators by weight: {indicators}. "
        "Score every class from 0 to 1. Give verbatim spans for every score over 0.3. If no score reaches 0.5, the class is UND; a class beside it with 0.5 is the secondary one; two such classes make a hybrid. "
        f"{MARKER} one JSON object with primary_class, confidence (high, medium or low), scores, evidence (class, metaphor_level, metaphor_type, span, weight, reasoning), secondary_class, is_hybrid, metaphor_analysis, notes."
    )


def section(o: Ontology = SHIPPED) -> str:
    """Levels and types with their weights, and for every theme the phrases that are images of images."""
    levels = "; ".join(f"{k} {w}" for k, w in LEVEL_WEIGHTS.items())
    types = "; ".join(f"{k} x{w}" for k, w in TYPE_WEIGHTS.items())
    images = "; ".join(f"{t}: {', '.join(x.term for x in o.of(t, 'artistic'))}" for t in o.themes)
    return f"LEVELS: {levels}. TYPES: {types}. IMAGES OF SCIENTIFIC IMAGES, each to be given with its source, its change and its theme: {images}. A phrase adds up to {KIND_SCORES['artistic']}."


def extended(prompt: str, o: Ontology = SHIPPED) -> str:
    """``prompt`` with the section before its marker; without the marker it stays as it is."""
    return prompt.replace(MARKER, f"{section(o)}\n\n{MARKER}")


def hint_sql(detected: str, theme: str) -> str:
    """A line that names the dominant theme where the pre-analysis found a pattern."""
    return f"CASE WHEN {detected} THEN concat('\n\nHint: an image of an image was found; dominant theme: ', coalesce({theme}, 'UND')) ELSE '' END"


def indicator_sql(level: str) -> str:
    """The indicator of the plain taxonomy that a level of evidence is: a term, a scientific phrase, any other image."""
    return f"CASE {level} WHEN 'explicit_term' THEN 'explicit' WHEN 'scientific_metaphor' THEN 'technical_cue' ELSE 'metaphor' END"
