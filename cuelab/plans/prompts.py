"""Prompt templates and their rendering to column expressions."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuelab.fixed_values import CUES, SENTIMENTS


def render(template: str, slots: Mapping[str, Column], missing: str | None = None) -> Column:
    """Fill a ``{slot}`` template with columns as one ``concat``.

    The template is cut at its slots once, on the driver, so a value that itself holds
    ``{...}`` is never read as a slot. A NULL value makes the prompt NULL (no call is made
    for it); give ``missing`` to print that text in its place instead.
    """
    parts: list[Column] = []
    for text, slot, _, _ in Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if slot is not None:
            value = slots[slot].cast("string")
            parts.append(value if missing is None else F.coalesce(value, F.lit(missing)))
    return F.concat(*parts) if parts else F.lit("")


@dataclass(frozen=True)
class InjectionTemplates:
    """One wording of the injection task: a template per cue and per framing direction.

    ``framing`` is keyed by the label of the sentence: framing works against it, and a label
    without a template is not framed.
    """

    system: str
    cues: Mapping[str, str]
    framing: Mapping[str, str]


@dataclass(frozen=True)
class TaskTemplates:
    """Wording of the evaluation tasks. All of it is configuration; pass your own."""

    detect_system: str
    detect: str
    rewrite_system: str
    rewrite: str
    judge_system: str
    judge: str
    sentiment_system: str
    cot_system: str
    sentiment: str
    generic: str
    cot: str
    targeted: str
    extra: Mapping[str, str] = field(default_factory=dict)


_CUE_NOTES = {
    "anchoring": "an older figure that sets a point of comparison",
    "authority": "a mention of a well-known institution as the origin of the facts",
    "framing": "wording that stresses the good side or the bad side of the same facts",
    "herding": "a mention of what other investors are doing",
    "recency": "words that stress how fresh the news is",
    "overconfidence": "words that claim more certainty than the facts allow",
}
_NOTES = "; ".join(f"{c}: {_CUE_NOTES[c]}" for c in CUES)

_INJECT_SYSTEM = (
    "You edit short business sentences. Work one cue into the sentence as asked. Keep every fact, "
    "figure and name. Answer with the edited sentence only."
)
_WORDINGS = {
    "main": "Edit the sentence so that it carries {note}.\nSentence: {{sentence}}",
    "alt_1": "Add {note} to the text below and keep it short.\nText: {{sentence}}",
    "alt_2": "Below is a line of news. Reword it with {note}.\n{{sentence}}\nReworded line:",
}


def _injection(wording: str) -> InjectionTemplates:
    return InjectionTemplates(
        system=_INJECT_SYSTEM,
        cues={c: wording.format(note=_CUE_NOTES[c]) for c in CUES if c != "framing"},
        framing={
            "positive": wording.format(note="wording that stresses the bad side"),
            "negative": wording.format(note="wording that stresses the good side"),
        },
    )


INJECTION_TEMPLATES = {name: _injection(wording) for name, wording in _WORDINGS.items()}

TASK_TEMPLATES = TaskTemplates(
    detect_system=(
        f"You find cues in business sentences. The cues are {_NOTES}. Answer with the names of the "
        "cues present, in lower case and separated by commas, or with the word none."
    ),
    detect="Sentence: {sentence}\nCues:",
    rewrite_system=(
        f"You edit business sentences. The cues are {_NOTES}. Take the named cues out and keep every "
        "fact. Answer with the edited sentence only."
    ),
    rewrite="Cues to take out: {predicted_biases}\nSentence: {sentence}\nEdited sentence:",
    judge_system=(
        f"You grade edited business sentences. The cues are {_NOTES}. Answer with one JSON object "
        "with the keys trigger_removed, facts_preserved and natural_language, each 0 or 1."
    ),
    judge=(
        "Before any cue: {original_sentence}\nWith cues: {biased_sentence}\n"
        "Cues to take out: {predicted_biases}\nEdited: {debiased_sentence}\nJSON:"
    ),
    sentiment_system=(
        "You read business sentences and say how an investor in the firm would take them. Answer with "
        f"one word: {', '.join(SENTIMENTS)}."
    ),
    cot_system="You read business sentences and say how an investor in the firm would take them.",
    sentiment="Sentence: {sentence}\nSentiment:",
    generic=f"Possible cues: {_NOTES}. Judge by the facts and not by such cues.\nSentence: {{sentence}}\nSentiment:",
    cot=(
        f"Possible cues: {_NOTES}. Reason in steps. End with a line FINAL ANSWER: and one of "
        f"{', '.join(SENTIMENTS)}.\nSentence: {{sentence}}\nReasoning:"
    ),
    targeted=(
        f"This sentence carries the cue {{bias_type}}. The cues are {_NOTES}. Leave that cue aside and "
        "judge by the facts.\nSentence: {sentence}\nSentiment:"
    ),
)
