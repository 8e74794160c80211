"""Units of time named in text: a multi-pattern automaton over unit aliases and field names, and the resolution of its hits.

Units are ``ticks`` (30 kHz), ``smp25k``, ``smp20k``, ``s``, ``ms`` and ``us``. Texts are folded first (lower case, micro signs to
``u``, runs of white space to one blank), and an alias only counts where it isn't part of a longer word or number. Of
overlapping hits the leftmost longest wins.
"""

from __future__ import annotations

import re
from functools import cache
from typing import NamedTuple

import ahocorasick

#: Microseconds in one unit, as a fraction.
MICROSECONDS = {"s": (1_000_000, 1), "ms": (1_000, 1), "us": (1, 1), "ticks": (100, 3), "smp25k": (40, 1), "smp20k": (50, 1)}
PER_SECOND = {unit: 1_000_000 * den / num for unit, (num, den) in MICROSECONDS.items()}

# Spellings of the clocks. {n} stands for the thousands of samples a second, {N} for the samples a second.
CLOCKS = {"ticks": ("30", "30000", "thirty"), "smp25k": ("25", "25000", "twenty-five"), "smp20k": ("20", "20000", "twenty")}
CLOCK_FORMS = ("{n} khz", "{n}khz", "{n}k", "{n} k", "{n} kilohertz", "{n} ks/s", "{N} hz", "{N}hz", "1/{N} s", "1/{N}", "{N} per second", "{N} samples", "{N}/s", "{N} samples per second")
CLOCK_WORDS = ("{w} kilohertz", "{w} khz", "{w} thousand", "{w} thousand per second")
# Other aliases.
ALIASES = {
    "s": ("s", "sec", "secs", "sec.", "second", "seconds"),
    "ms": ("ms", "msec", "msecs", "msec.", "millisec", "millisec.", "millisecs", "millisecond", "milliseconds", "milli seconds", "milli-seconds", "thousandths of a second", "thousandth of a second", "1/1000 s", "0.001 s"),
    "us": ("us", "usec", "usecs", "usec.", "microsec", "microsec.", "microsecs", "microsecond", "microseconds", "micro seconds", "micro-seconds", "millionths of a second", "millionth of a second", "1/1000000 s", "0.001 ms", "mus", "mcs"),
    "ticks": ("ticks", "tick", "tk", "tks", "acquisition ticks", "clock ticks"),
    "smp25k": ("0.04 ms", "40 us", "0.00004 s"),
    "smp20k": ("0.05 ms", "50 us", "0.00005 s"),
    "?": ("samples", "sample", "smp"),
    "not": ("not", "no", "never", "instead of", "rather than"),
}
#: A number right before one of these is an amount (16.7 ms), not the unit of a column; a step size is told by its context.
STEPS = ("one step =", "one step is", "step =", "step of", "one unit =", "one unit is", "resolution", "lsb =")
# How notes name the fields.
FIELDS = {
    "spikes": ("spikes", "spike times", "spike time", "spike file", "spk file", "spk", "spike", "unit times", "unit time"),
    "pico": ("pico", "pico file", "pico intervals", "pico start/end", "stimulus intervals", "stimulus interval", "stim intervals", "interval times", "intervals"),
}


class Hit(NamedTuple):
    start: int
    end: int
    kind: str
    text: str


def fold(text: str) -> str:
    return re.sub(r"\s+", " ", text.replace("µ", "u").replace("μ", "u").replace(" ", " ").replace(" ", " ").lower()).strip()


@cache
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()

    def add(kind: str, alias: str) -> None:
        a.add_word(alias, (kind, alias))

    for unit, aliases in ALIASES.items():
        for alias in aliases:
            add(unit, alias)
    for unit, (n, full, word) in CLOCKS.items():
        for form in CLOCK_FORMS:
            for spelled in {full, f"{full[:-3]} {full[-3:]}", f"{full[:-3]},{full[-3:]}", f"{full[:-3]}.{full[-3:]}"}:
                add(unit, form.format(n=n, N=spelled))
        for form in CLOCK_WORDS:
            for spelled in {word, word.replace("-", " "), word.replace("-", "")}:
                add(unit, form.format(w=spelled))
    for step in STEPS:
        add("step", step)
    for field, names in FIELDS.items():
        for name in names:
            add(field, name)
    a.make_automaton()
    return a


def _alone(text: str, start: int, end: int) -> bool:
    before, after = text[start - 1 : start], text[end : end + 1]
    first, last = text[start], text[end - 1]
    if before and (before.isalpha() and first.isalpha() or before.isdigit() and first.isdigit()):
        return False
    if first.isdigit() and before in {".", ","} and text[max(0, start - 2) : start - 1].isdigit():
        return False
    return not (after and (after.isalnum() if last.isalpha() else after.isdigit() and last.isdigit()))


def scan(text: str) -> list[Hit]:
    """The hits in a folded text, leftmost longest, not overlapping."""
    found = sorted((Hit(end + 1 - len(alias), end + 1, kind, alias) for end, (kind, alias) in automaton().iter(text)), key=lambda h: (h.start, -h.end))
    out: list[Hit] = []
    at = 0
    for hit in found:
        if hit.start >= at and _alone(text, hit.start, hit.end):
            out.append(hit)
            at = hit.end
    return out


def unit_of_entry(text: str | None) -> str | None:
    """The unit a whole entry such as ``samples @20kHz`` names, else None. A clock beats the bare word ``ticks`` or ``samples``."""
    if not text:
        return None
    units = [h.kind for h in scan(fold(text)) if h.kind in MICROSECONDS]
    clocks = [u for u in units if u in CLOCKS and u != "ticks"]
    return clocks[0] if clocks else units[0] if units else None


def unit_of_field(note: str | None, field: str) -> str | None:
    """The unit a note gives for ``field`` (``spikes`` or ``pico``): the first unit after a mention of the field and before a
    mention of another. Amounts (a number before the alias) don't count unless a step size is spoken of, negated units never."""
    if not note:
        return None
    text = fold(note)
    hits = scan(text)
    now, step, negated = None, -1, -1
    for hit in hits:
        if hit.kind in FIELDS:
            now = hit.kind
        elif hit.kind == "step":
            step = hit.end
        elif hit.kind == "not":
            negated = hit.end
        elif now == field and hit.kind in MICROSECONDS:
            amount = re.search(r"[\d.,]+ ?$", text[: hit.start]) is not None and not re.match(r"\d", hit.text)
            close = lambda mark: 0 <= mark <= hit.start and hit.start - mark <= 2  # noqa: B023, E731
            stepped = re.match(r"0\.|\d+ us", hit.text) is not None
            if close(negated) or (amount or stepped) and not close(step):
                continue
            return hit.kind
    return None


class Reading(NamedTuple):
    """A stored amount: candidate numbers (a comma may divide thousands or decimals) and the unit, None where it isn't told."""

    values: tuple[float, ...]
    unit: str | None


NUMBER = re.compile(r"[-+]?\d[\d.,' ]*(?:e[-+]?\d+)?", re.I)


def read_amount(text: str | None) -> Reading | None:
    """The number and unit in a text such as ``dur=148.0ms``, ``296,000 us``, ``0,2990 s``, ``301.0e3 us`` or ``9003 @30kHz``."""
    if text is None or not (m := NUMBER.search(folded := fold(text))):
        return None
    unit = unit_of_entry(folded[: m.start()] + " " + folded[m.end() :])
    return Reading(tuple(_numbers(m.group().strip(" .,'"))), unit)


def _numbers(number: str) -> list[float]:
    number = number.replace(" ", "").replace("'", "")
    out = []
    if "," in number and "." in number:
        decimal = max(number.rfind(","), number.rfind("."))
        out.append(re.sub(r"[.,]", "", number[:decimal]) + "." + number[decimal + 1 :])
    elif number.count(",") + number.count(".") > 1:
        out.append(re.sub(r"[.,]", "", number))
    elif "," in number:
        whole = re.fullmatch(r"[-+]?[1-9]\d{0,2},\d{3}", number) is not None
        out += [number.replace(",", ""), number.replace(",", ".")] if whole else [number.replace(",", ".")]
    else:
        out.append(number)
    values = []
    for text in out:
        try:
            values.append(float(text))
        except ValueError:
            continue
    return values
