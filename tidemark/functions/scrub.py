"""Personal data scrubbed from short texts by ordered rules, as column expressions.

Each rule claims spans of the original text. A span is claimed by the first rule that asks for it; what overlaps a claim goes. Claims of rules
that keep protect company numbers from the rules after them. Labelled rules come before those that look at the shape alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import checks

# Labels, patterns and slots of the rules. The value is the first group, which ends a match, or the whole match.
_SUFFIX = r"\)?\s*(?:number|no|nr|#|declaration|form|details|record|is|reads|shows)?\.?\s*[:#=]?\s*"
_NUMERIC = r"\d[\d \-]{5,22}\d"
_ALNUM = r"[A-Za-z0-9-]*\d[A-Za-z0-9-]*(?:[ ][A-Za-z0-9-]*\d[A-Za-z0-9-]*){0,4}(?:[ ][A-Za-z]\b)?"
_DATE_LIKE = r"^\d{4}([-/.])\d{1,2}(?:\1\d{1,2})?$|^\d{1,2}([./-])\s?\d{1,2}\2\s?\d{4}$|^\d{4}-\d{4}$"
_DOTTED_QUAD = r"^\d{1,3}(?:\.\d{1,3}){3}$"
_GROUPED_AMOUNT = r"^\s*\d{1,3}(?: \d{3})+\s*$"
_SECRETS = (
    r"\b(?:sk-[A-Za-z0-9_-]{16,}|gh[pousr]_[A-Za-z0-9]{16,}|github_pat_[A-Za-z0-9_]{20,}|AKIA[A-Z0-9]{16}|xox[baprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{8,})\b"
)
_NAMED_SECRETS = r"(?i)\b[A-Za-z0-9_.-]*(?:secret|token|api[_-]?key|apikey|access[_-]?key|private[_-]?key)\b\s*[:=]\s*(?!\[)(\S{6,})"
_PASSWORDS = (
    r"(?i)\b(?:password|passwd|passphrase|pwd|pass)\s*[:=]\s*(?!\[)(\S{4,})",
    r"(?i)\b(?:password|passphrase)\s+(?!\[)((?=\S*[\d#!@$%^&*+=])\S{6,})",
    r"(?i)\b(?:password|passwd|passphrase)\s*\n\s*(?!\[)((?=\S*[\d#!@$%^&*+=])\S{6,})",
)
_MONTHS = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_BIRTH = rf"(?i)\b(?:date of birth|birth ?date|dob|born(?: on)?)\s*[:=]?\s*(?:(?:to|is)\s+)?((?:\d{{1,2}}[/. -]){{2}}\d{{2,4}}|\d{{4}}-\d{{2}}-\d{{2}}|{_MONTHS}\.? \d{{1,2}},? \d{{4}})"
_EMPLOYEE = r"(?i)\b(?:employee|badge|worker|staff|emp)\s*(?:id|no|number)?\.?\s*[:#]?\s*((?=[A-Za-z0-9-]*\d{4})[A-Za-z0-9-]{4,})"
_BANK, _IBAN = "bsb(?: and)?(?: account)?|bank account|account|acct|acc|a/c|routing|aba", "iban|swift|bic"
_PAPERS = r"passport|driver'?s?\s*licen[cs]e|licen[cs]e|crn|customer reference|centrelink|visa grant|medicare provider"
_PHONES = "tel|telephone|phone|mobile|mob|cell|fax|direct line"
_LOCAL_PHONE = r"(?:\+6[14][ -]?\(?0?\)?[ -]?|\b0)[2-9](?:[ -]?\d){7,9}\b"
_ANY_PHONE = r"(?:\+\d|\(\d{2,4}\)|\b\d{3}[ .-]\d{3}[ .-]\d{2,4}\b)(?:[\d\s().-]{0,18}\d)?"


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _card(v: Column) -> Column:
    d = _digits(v)
    return F.when(F.length(d).between(13, 19), F.call_function("luhn_check", d)).otherwise(False)


def _phone(least: int, most: int, plain: bool) -> Callable[[Column], Column]:
    """Digits within bounds that aren't a date or an address; plain: digits and blanks alone may be one."""

    def check(v: Column) -> Column:
        fits = F.length(_digits(v)).between(least, most) & ~v.rlike(_DATE_LIKE) & ~v.rlike(_DOTTED_QUAD)
        return fits if plain else fits & ~v.rlike(r"^[\d ]+$")

    return check


def _has_digit(v: Column) -> Column:
    return v.rlike("[0-9]")


@dataclass(frozen=True)
class Rule:
    """slot takes the span's place, None: the span stays. bounded: the span mustn't hang together with letters by signs of words."""

    slot: str | None
    pattern: str
    group: int = 0
    valid: Callable[[Column], Column] | None = None
    bounded: bool = False


def _labelled(slot: str | None, labels: str, value: str, valid: Callable[[Column], Column] | None = None) -> Rule:
    return Rule(slot, rf"(?i)\b(?:{labels}){_SUFFIX}({value})", 1, valid)


# The order of the rules.
RULES = (
    _labelled(None, "abn|australian business number", _NUMERIC), _labelled(None, "acn|australian company number", _NUMERIC), _labelled(None, "nzbn", _NUMERIC),
    Rule(None, r"(?i)\bBSB:? ?\d{3}[- ]?\d{3}\b(?![- ]?\d)"),
    Rule("[redacted secret]", _SECRETS), Rule("[redacted secret]", _NAMED_SECRETS, 1),
    *(Rule("[redacted password]", p, 1) for p in _PASSWORDS),
    Rule("[redacted date of birth]", _BIRTH, 1), Rule("[redacted employee id]", _EMPLOYEE, 1),
    _labelled("[bank account]", _BANK, _NUMERIC, lambda v: ~v.rlike(_GROUPED_AMOUNT)), _labelled("[bank account]", _IBAN, _ALNUM, _has_digit),
    _labelled("[medicare number]", "medicare", _NUMERIC), _labelled("[tax file number]", "tfn|tax file", _NUMERIC), _labelled("[ird number]", "ird", _NUMERIC),
    _labelled("[ird number]", "gst", _NUMERIC, checks.passes_ird), _labelled("[nhi number]", "nhi", _ALNUM, _has_digit), _labelled("[id number]", "ssn|social security|taxpayer id", _NUMERIC),
    _labelled("[id number]", _PAPERS, _ALNUM, _has_digit), _labelled("[phone number]", _PHONES, _NUMERIC),
    Rule(None, r"\b\d{2} ?\d{3} ?\d{3} ?\d{3}\b", 0, checks.passes_abn), Rule(None, r"\b\d{3} ?\d{3} ?\d{3}\b", 0, checks.passes_acn),
    Rule("[bank account]", r"\b\d{2}-\d{4}-\d{7}-\d{2,3}\b"), Rule("[bank account]", r"\b\d{3}[- ]\d{3}[ ,/]+(\d{6,10})\b", 1),
    Rule("[medicare number]", r"\b\d{4} ?\d{5} ?\d(?: ?\d)?\b", 0, checks.passes_medicare), Rule("[ird number]", r"\b\d{2,3}[- ]\d{3}[- ]\d{3}\b", 0, checks.passes_ird),
    Rule("[nhi number]", r"\b[A-HJ-NP-Z]{3}\d{4}\b", 0, checks.passes_nhi), Rule("[payment card]", r"\b\d(?:[ -]?\d){12,18}\b", 0, _card, True), Rule("[id number]", r"\b\d{3}[- ]\d{2}[- ]\d{4}\b"),
    Rule("[phone number]", _LOCAL_PHONE, 0, _phone(9, 12, True), True), Rule("[phone number]", _ANY_PHONE, 0, _phone(7, 15, False), True),
)

_SPAN = "struct<start:int,end:int,rule:int>"


def _spans(text: Column, number: int, rule: Rule) -> Column:
    """The rule's sound spans in order, without signs of a sentence at their end. The gaps between matches tell the places."""
    found, gaps = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.split(text, rule.pattern, -1)
    values = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found

    def add(state: Column, x: Column) -> Column:
        end = state["pos"] + F.length(x["gap"]) + F.length(x["m"])
        start = end - F.length(x["v"])
        bare = F.regexp_replace(x["v"], "[.,;:!?]+$", "")
        value = F.when(bare == "", x["v"]).otherwise(bare)
        stop = start + F.length(value)
        good = rule.valid(value) if rule.valid else F.lit(True)
        if rule.bounded:
            good = good & ~F.substring(text, F.lit(1), start).rlike(r"[A-Za-z_][\w-]*$") & ~F.substring(text, stop + 1, F.length(text)).rlike(r"^[\w-]*[A-Za-z_]")
        span = F.struct(start.cast("int").alias("start"), stop.cast("int").alias("end"), F.lit(number).alias("rule"))
        return F.struct(end.cast("int").alias("pos"), F.concat(state["out"], F.when(F.coalesce(good, F.lit(False)), F.array(span)).otherwise(F.array().cast(f"array<{_SPAN}>"))).alias("out"))

    parts = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("m"), values.alias("v"))
    start = F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{_SPAN}>").alias("out"))
    return F.when(text.rlike(rule.pattern), F.aggregate(parts, start, add, lambda s: s["out"])).otherwise(F.array().cast(f"array<{_SPAN}>"))


def claims(text: Column) -> Column:
    """Claimed spans (start, end, rule), in order of their rules. The work grows with the square of a text's spans: for short texts."""
    every = F.concat(*(_spans(text, i, r) for i, r in enumerate(RULES)))
    taken = lambda held, s: F.exists(held, lambda c: (s["start"] < c["end"]) & (s["end"] > c["start"]))
    return F.aggregate(every, F.array().cast(f"array<{_SPAN}>"), lambda held, s: F.when(taken(held, s), held).otherwise(F.concat(held, F.array(s))))


def scrubbed(text: Column) -> Column:
    """The text with claimed spans replaced by their rules' slots; names and mail addresses stay, as no rule asks for them. Null stays null."""
    slots = F.array(*(F.lit(r.slot) for r in RULES))
    shown = F.array_sort(F.filter(claims(text), lambda c: F.get(slots, c["rule"]).isNotNull()))
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    step = lambda s, c: F.struct(c["end"].alias("pos"), F.concat(s["out"], F.substring(text, s["pos"] + 1, c["start"] - s["pos"]), F.get(slots, c["rule"])).alias("out"))
    return F.aggregate(shown, start, step, lambda s: F.concat(s["out"], F.substring(text, s["pos"] + 1, F.length(text))))
