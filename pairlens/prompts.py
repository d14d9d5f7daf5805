"""Prompt templates, in this library's own wording, addressed by name."""

from __future__ import annotations

TEMPLATES = {
    "interpret-feature-top-pairs": (
        "Each example below holds a CONTEXT and two answers to it, RESPONSE A and RESPONSE B. In all "
        "examples the answers differ along one and the same trait.\n"
        "Name that trait as it shows in RESPONSE A. If only the B answers have it, say that it is "
        "absent. Be concrete and brief, avoid comparatives and do not mention the letters.\n\n"
        "{examples}\n\n"
        'Reply with one line: a dash, then the trait in double quotes.\n- "'
    ),
    "pairwise-annotate-singleconcept": (
        "Two answers to the same context are shown below. Which of them shows the concept more "
        "clearly?\nReply with one word: A, B or Tie. Reply Tie if the concept fits neither, fits both "
        "alike, or if you are unsure. Judge the two final responses only, not their quality.\n\n"
        "{text}\n\nCONCEPT: {concept}\nANSWER:"
    ),
    "pairwise-annotate-multiconcept": (
        "Two answers to the same context are shown below. For each concept say which answer shows "
        "it more clearly: A, B or Tie. Use Tie whenever the difference is not obvious.\n"
        "Reply with one list in square brackets, one entry per concept and in the given order.\n\n"
        "CONCEPTS:\n{concepts_block}\n\n{text}\nANSWER:"
    ),
    "abbreviate-concept": (
        "Shorten the description below as far as possible without changing what it means. Reply "
        "with the shortened description only.\n\nDescription: {concept}\nShort form:"
    ),
}

# Older names still accepted.
ALIASES = {"annotate-pairwise": "pairwise-annotate-singleconcept"}


def canonical(name: str) -> str:
    return ALIASES.get(name, name)


def template(name: str) -> str:
    known = TEMPLATES.get(canonical(name))
    if known is None:
        raise KeyError(f"no prompt template named {name!r}")
    return known


def add_template(name: str, text: str) -> None:
    """Make a template of one's own available under ``name``."""
    TEMPLATES[name] = text
