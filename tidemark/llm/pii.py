"""Personal data: base patterns with checks, and further spans chosen by candidate gradient boosting. DataFrame expressions only.

Generators of high recall propose spans, which may overlap. Boosted trees score each by its format and its context alone. They are fitted on
counts of candidates by binned features (a table of bounded size) in one half of the texts. The labels come from what the features don't see:
base patterns and checks of the digits or letters themselves (Luhn, octets, IBAN remainders, the mixture of a secret). PLANTED texts, whose
candidates are known, stand for formats that no check tells, and for tables that have few. The scores are calibrated on the other half, where the
least score of each kind is chosen that keeps the precision.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut

KINDS = ("email", "ip", "card", "phone", "secret", "id")
#: Base patterns. Possessive, and tried only where a match can begin, so that each reads a text once; they match what the plain forms match.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match of the kind.
GATES = {"email": "@", "ip": ".", "card": None, "phone": "+"}
# Lengths of international bank account numbers by country, from the public registry.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}


def _iban_pattern() -> str:
    """Account numbers in groups of four signs, or in one piece: of the length that the country has, or of any where the country is unknown."""
    four, known = r"(?:\x20?[A-Z0-9]{4})", "|".join("|".join(x.split()) for x in IBAN_LENGTHS.values())
    own = [f"(?:{'|'.join(x.split())})[0-9]{{2}}{four}{{{(n - 4) // 4}}}" + (rf"\x20?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, x in IBAN_LENGTHS.items()]
    return "|".join([*own, rf"(?!{known})[A-Z]{{2}}[0-9]{{2}}{four}{{2}}(?:\x20?[A-Z0-9]{{3}}|{four}{{1,5}}(?:\x20?[A-Z0-9]{{1,2}})?)"])


#: Candidates: kind, pattern.
GENERATORS = (
    ("email", r"(?i)(?:\G|(?<![a-z0-9._%+-]))[a-z0-9._%+-]++(?:@|\x20?[(\[]at[)\]]\x20?)[a-z0-9-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[a-z0-9-]++)++"),
    ("ip", r"(?<![0-9A-Fa-f.:])(?:[0-9]{1,9}(?:\.[0-9]{1,9}){3}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7})(?![0-9A-Fa-f:])"),
    ("card", r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){11,18}(?![0-9])"),
    ("phone", r"(?<![0-9])(?:\+|00)?\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,14}(?![0-9])"),
    ("secret", r"(?i)(?<![a-z0-9])(?:token|secret|password|passwd|api[_-]?key)[\"']?\x20?[=:]\x20?[\"']?[a-z0-9+/_-]{16,}+"),
    ("id", rf"(?<![A-Za-z0-9])(?:{_iban_pattern()}|[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}})(?![A-Za-z0-9])"),
)
#: Words that announce personal data, by kind.
CUES = (
    ("email", "mail|contact|write"),
    ("ip", "ip|address|host|client|login"),
    ("card", "card|visa|master|credit|pay|carte|karte|tarjeta"),
    ("phone", "tel|phone|call|fax|mobil|cell|ruf|llam"),
    ("secret", "token|secret|password|passwd|key"),
    ("id", "ssn|social|iban|account|konto|compte|cuenta"),
)
FEATURES = ("kind", "digits", "separators", "brackets", "letters", "cue", "joined")
#: Texts whose candidates all are personal data (1), or all are none (0).
PLANTED = (
    ("mail me: jane.roe (at) example (dot) org", 1), ("contact joe[at]example[dot]net", 1), ("write to ann.lee@example.com", 1),
    ("call (212) 555-0142 today", 1), ("phone 212-555-0142", 1), ("tel. 0171 555 0142", 1), ("fax: 030.555.01420", 1), ("mobile +44 (20) 7946-0958", 1),
    ("order 20240102", 0), ("from 2024-01-02 to 2024-01-31", 0), ("pi is 3.14159265358", 0), ("item 12345678 of 87654321", 0), ("on 01.02.2024", 0), ("isbn 978 3 16 148410", 0),
    ("password: hunter2hunter2hunter2", 1), ("api_key=AKQ7x9Zt3mB8vN2wL5pR", 1), ("token = \"9f8e7d6c5b4a39281706f5e4\"", 1), ("secret='d0Nt-t3ll-4ny-0ne-th1s'", 1),
    ("password: aaaaaaaaaaaaaaaa", 0), ("token: ----------------", 0), ("the secret: unbelievably-straightforward", 0),
    ("ssn 219-09-9999", 1), ("social security 078-05-1120", 1), ("iban GB82 WEST 1234 5698 7654 32", 1), ("account DE89 3704 0044 0532 0130 00", 1), ("part 000-12-3456", 0), ("code AB12 CDEF 3456 GHIJ 78KL", 0),
    ("host 2001:db8:85a3:0:0:8a2e:370:7334", 1), ("client fe80::1ff:fe23:4567:890a", 1), ("at 12:30:45:11", 0), ("login from 192.168.7.14", 1), ("version 1.2.3.400", 0),
    ("card 4111.1111.1111.1111", 1), ("pay by 5500 0000 0000 0004", 1),
)
#: What a planted text counts as, against texts of the documents.
_PLANTED_WEIGHT = 5
#: Of candidates that meet, the one whose kind comes first here stays: account numbers before cards, and phone numbers last, as parts of the others look like them.
_FIRST = ("email", "ip", "id", "card", "secret", "phone")
_BLOCK, _CHUNK = 64, 4096


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def value(i):
        d = F.ascii(F.substring(digits, i, F.lit(1))) - 48
        twice = d * (1 + (F.length(digits) - i) % 2)
        return twice - F.when(twice > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def _octets(m: Column) -> Column:
    def small(p):
        bare = F.regexp_replace(p, "^0+", "")
        return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))

    return F.forall(F.split(m, r"\."), small)


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return _octets(m)
    n = F.length(_digits(m))
    if kind == "card":
        return F.when(n.between(12, 19), _luhn(_digits(m))).otherwise(F.lit(False))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _checked(kind: str) -> Callable[[Column], Column]:
    return lambda s: _valid(kind, s["m"])


def _failed(kind: str) -> Callable[[Column], Column]:
    return lambda s: ~_valid(kind, s["m"])


_SPAN = "array<struct<kind:int,start:int,end:int,m:string,before:string,after:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often lambdas in the body use it."""
    return F.transform(F.array(value), body)[0]


def _scanned(items: Column, start: Column, step: Callable[[Column, Column], Column], made: Callable[[Column, Column], Column], kind: str) -> Column:
    """made(state before x, x) for each x of an array that isn't empty, where step gives the next state. Runs over about as many blocks as each has items, so a long array costs no square."""

    def cut_up(p):
        size = F.greatest(F.lit(_BLOCK), F.ceil(F.sqrt(F.size(p))).cast("int"))
        return _let(size, lambda n: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / n).cast("int")), lambda b: F.slice(p, b * n + 1, n)))

    def one(a, x):
        return F.struct(step(a["state"], x).alias("state"), F.concat(a["out"], F.array(made(a["state"], x))).alias("out"))

    def block(a, b):
        inner = F.aggregate(b, F.struct(a["state"].alias("state"), F.array().cast(f"array<{kind}>").alias("out")), one)
        return _let(inner, lambda r: F.struct(r["state"].alias("state"), F.concat(a["out"], F.array(r["out"])).alias("out")))

    first = F.struct(start.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.flatten(F.aggregate(_let(items, cut_up), first, block)["out"])


def _located(found: Column, gaps: Column, kind: int, context: bool) -> Column:
    """Spans of the matches, of which the gaps between them tell the places, and what stands around each up to the next match."""
    n = F.size(gaps)
    parts = F.arrays_zip(F.slice(gaps, F.lit(1), n - 1).alias("gap"), found.alias("m"), F.slice(gaps, F.lit(2), n - 1).alias("next"))
    around = lambda x: (F.right(x["gap"], F.lit(30)), F.substring(x["next"], 1, 1)) if context else (F.lit(""), F.lit(""))

    def made(pos, x):
        start = pos + F.length(x["gap"])
        before, after = around(x)
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(x["m"])).alias("end"), x["m"].alias("m"), before.alias("before"), after.alias("after"))

    return _scanned(parts, F.lit(0), lambda pos, x: pos + F.length(x["gap"]) + F.length(x["m"]), made, _SPAN[6:-1])


def _found(df: DataFrame, patterns: list[tuple[str, int, str, Column]], context: bool = False) -> DataFrame:
    """Adds a column of spans for each (name, kind, pattern, gate); null where there is none."""
    out = df.select("*", *(F.when(gate, F.regexp_extract_all("__t", F.lit(p), F.lit(0))).alias(f"{name}_m") for name, _, p, gate in patterns))
    some = {name: F.size(F.col(f"{name}_m")) > 0 for name, *_ in patterns}
    out = out.select(*df.columns, *(f"{name}_m" for name, *_ in patterns), *(F.when(some[name], F.split("__t", p, -1)).alias(f"{name}_g") for name, _, p, _ in patterns))
    return out.select(*df.columns, *(F.when(some[name], _located(F.col(f"{name}_m"), F.col(f"{name}_g"), kind, context)).alias(name) for name, kind, *_ in patterns))


def _none(spans: Column) -> Column:
    return F.coalesce(spans, F.array().cast(_SPAN))


def _with_spans(docs: DataFrame, text: str) -> DataFrame:
    """Adds __t (the text), base_ (spans of base patterns that pass), refused (that fail) and cands (all candidates)."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.select("*", t.alias("__t"))
    digits = F.when(F.col("__t").rlike("[0-9]"), True).otherwise(False)
    df = df.select("*", digits.alias("__d"))
    gates = {k: F.col("__d") & F.contains(F.col("__t"), F.lit(g)) if g else F.col("__d") for k, g in GATES.items()} | {"email": F.contains(F.col("__t"), F.lit("@"))}
    base = _found(df, [(f"__b{i}", i, BASE[k], gates[k]) for i, k in enumerate(BASE)])
    passed = [F.filter(_none(F.col(f"__b{i}")), _checked(k)) for i, k in enumerate(BASE)]
    base = base.select(*df.columns, *(F.col(f"__b{i}") for i in range(len(BASE))), F.concat(*passed).alias("base_"))
    refused = F.concat(*(F.filter(_none(F.col(f"__b{i}")), _failed(k)) for i, k in enumerate(BASE)))
    base = base.select(*df.columns, "base_", F.when(F.col("__d"), refused).otherwise(F.array().cast(_SPAN)).alias("refused"))
    cue = F.col("__t").rlike(r"(?i)token|secret|passw|api[_-]?key")
    wants = [F.col("__t").rlike(r"@|(?i)[(\[]at[)\]]"), F.col("__d"), F.col("__d"), F.col("__d"), cue, F.col("__d")]
    all_ = _found(base, [(f"__c{i}", KINDS.index(k), p, wants[i]) for i, (k, p) in enumerate(GENERATORS)], True)
    return all_.select(*base.columns, F.concat(*(_none(F.col(f"__c{i}")) for i in range(len(GENERATORS)))).alias("cands"))


_RANKED = "struct<start:int,rank:int,end:int,kind:int,m:string,before:string,after:string>"


def _ranked(s: Column, rank: Column) -> Column:
    return F.struct(s["start"].alias("start"), rank.cast("int").alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["m"].alias("m"), s["before"].alias("before"), s["after"].alias("after"))


def _met(items: Column, ranks: int) -> Column:
    """(x, met) for each item x of a rank above 0, in order: whether it meets one of a lower rank. Two passes over the sorted items, whatever their number."""
    none = F.array(*(F.lit(-1) for _ in range(ranks)))
    far = F.array(*(F.lit(2**31 - 1) for _ in range(ranks)))
    marked = f"struct<x:{_RANKED},met:boolean>"

    def ends(a, x):  # greatest end so far of each rank or a lower one
        return F.transform(a, lambda v, r: F.when(x["rank"] <= r, F.greatest(v, x["end"])).otherwise(v))

    def starts(a, y):  # least start so far, from the end on
        return F.transform(a, lambda v, r: F.when(y["x"]["rank"] <= r, F.least(v, y["x"]["start"])).otherwise(v))

    def ahead(a, x):
        return F.struct(x.alias("x"), ((x["rank"] > 0) & F.coalesce(F.get(a, x["rank"] - 1) > x["start"], F.lit(False))).alias("met"))

    def behind(a, y):
        return F.struct(y["x"].alias("x"), (y["met"] | ((y["x"]["rank"] > 0) & F.coalesce(F.get(a, y["x"]["rank"] - 1) < y["x"]["end"], F.lit(False)))).alias("met"))

    there = _scanned(F.array_sort(items), none, ends, ahead, marked)
    back = F.reverse(_scanned(F.reverse(there), far, starts, behind, marked))
    return F.filter(back, lambda y: y["x"]["rank"] > 0)


def _clear(items: Column, ranks: int) -> Column:
    """The items of ranks above 0 that meet none of a lower rank."""
    return F.transform(F.filter(_met(items, ranks), lambda y: ~y["met"]), lambda y: y["x"])


def _against(spans: Column, others: Column) -> Column:
    """(x, met) for each of the spans: whether it meets any of the others."""
    both = F.concat(F.transform(others, lambda s: _ranked(s, F.lit(0))), F.transform(spans, lambda s: _ranked(s, F.lit(1))))
    alone = F.transform(spans, lambda s: F.struct(_ranked(s, F.lit(1)).alias("x"), F.lit(False).alias("met")))
    return F.when((F.size(spans) > 0) & (F.size(others) > 0), _met(both, 1)).otherwise(alone)


def _free_of(spans: Column, others: Column) -> Column:
    """The spans that meet none of the others, and numbers (`id`) that hold whole all they meet: digits of an account number may look like a card's."""

    def whole(x):
        return F.forall(others, lambda o: (o["end"] <= x["start"]) | (o["start"] >= x["end"]) | ((o["start"] >= x["start"]) & (o["end"] <= x["end"])))

    return F.transform(F.filter(_against(spans, others), lambda y: ~y["met"] | ((y["x"]["kind"] == KINDS.index("id")) & whole(y["x"]))), lambda y: y["x"])


def _described(s: Column) -> Column:
    """The binned features of a candidate, as a struct: its format and its context, not whether its digits pass a check."""
    m, digits = s["m"], _digits(s["m"])
    n = F.length(digits)
    kinds = [m.rlike(x).cast("int") for x in ("[0-9A-F]\x20", "[0-9]-", r"[0-9]\.")]
    mixed = kinds[0] + kinds[1] + kinds[2] > 1
    cue = F.coalesce(*(F.when(s["kind"] == KINDS.index(k), F.lower(F.concat(s["before"], F.when(s["kind"] == KINDS.index("secret"), m).otherwise(F.lit("")))).rlike(words)) for k, words in CUES), F.lit(False))
    joined = s["after"].rlike("[A-Za-z0-9@]") | F.right(s["before"], F.lit(1)).rlike("[A-Za-z0-9@.]")
    return F.struct(
        s["kind"].alias("kind"), (F.when(n < 7, 0).when(n < 9, 1).when(n < 12, 2).when(n < 16, 3).otherwise(4)).alias("digits"),
        F.when(mixed, 4).when(kinds[0] == 1, 1).when(kinds[1] == 1, 2).when(kinds[2] == 1, 3).when(F.contains(m, F.lit("::")), 6).when(F.contains(m, F.lit(":")) & (s["kind"] == 1), 5).otherwise(0).alias("separators"),
        F.contains(m, F.lit("(")).cast("int").alias("brackets"), (F.when(m.rlike("[A-Za-z]") & m.rlike("[0-9]"), 2).when(m.rlike("[A-Za-z]"), 1).otherwise(0)).alias("letters"), cue.cast("int").alias("cue"), joined.cast("int").alias("joined"),
    )


def _iban(m: Column) -> Column:
    """Whether the remainder of a bank account number is right."""
    bare = F.regexp_replace(m, "\x20", "")
    turned = F.concat(F.substring(bare, 5, 99), F.substring(bare, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.regexp_extract_all(turned, F.lit("."), F.lit(0)), F.lit(0), lambda a, c: (F.when(value(c) > 9, a * 100).otherwise(a * 10) + value(c)) % 97)
    return rest == 1


def _labelled(s: Column) -> Column:
    """1 or 0 by checks of the characters themselves; null where there is no check."""
    m, bare = s["m"], F.regexp_replace(F.lower(s["m"]), "^.*?[=:]\\x20?[\"']?", "")
    groups = F.size(F.split(m, ":"))
    ip6 = F.when(F.contains(m, F.lit("::")), groups <= 8).otherwise(groups == 8)
    n = F.length(_digits(m))
    kinds = F.size(F.array_distinct(F.split(bare, "")))
    out = F.when(s["kind"] == 1, F.when(F.contains(m, F.lit(".")), _octets(m)).otherwise(ip6))
    out = out.when(s["kind"] == 2, F.when(n.between(12, 19), _luhn(_digits(m))).otherwise(F.lit(False)))
    out = out.when(s["kind"] == 4, bare.rlike("[0-9]") & bare.rlike("[a-z]") & (kinds >= 8))
    out = out.when(s["kind"] == 5, F.when(m.rlike("^[0-9]"), ~m.rlike("^(000|666|9)|-00-|-0000$")).otherwise(_iban(m)))
    return out.cast("int")


Cell = tuple[tuple[int, ...], int, float]


@dataclass
class Boosted:
    """Trees of depth 2: (feature, value, feature, value if not above, feature, value if above, four leaves). Thresholds are by kind."""

    bias: float = 0.0
    trees: list[tuple] = field(default_factory=list)
    thresholds: tuple[float, ...] = (math.inf,) * len(KINDS)

    def margin(self, x: tuple[int, ...]) -> float:
        out = self.bias
        for f, v, lf, lv, rf, rv, leaves in self.trees:
            above = x[f] > v
            out += leaves[2 * above + (x[rf] > rv if above else x[lf] > lv)]
        return out

    def column(self, x: Column) -> Column:
        out = F.lit(self.bias)
        for f, v, lf, lv, rf, rv, leaves in self.trees:
            left = F.when(x[FEATURES[lf]] > lv, leaves[1]).otherwise(leaves[0])
            right = F.when(x[FEATURES[rf]] > rv, leaves[3]).otherwise(leaves[2])
            out = out + F.when(x[FEATURES[f]] > v, right).otherwise(left)
        return out

    def selects(self, x: Column) -> Column:
        least = F.coalesce(*(F.when(x["kind"] == k, F.lit(float(v))) for k, v in enumerate(self.thresholds)), F.lit(math.inf))
        return self.column(x) >= least


def boost(cells: list[Cell], held: list[Cell] | None = None, rounds: int = 30, rate: float = 0.4, precision: float = 0.9) -> Boosted:
    """Gradient boosting of the logistic loss over weighted cells; calibration, and for each kind the lowest threshold that keeps this precision, on
    the held-out cells (None: on the same). Where a kind has no held-out cells or no such threshold, it adds nothing."""
    held = cells if held is None else held
    total = sum(w for *_, w in cells)
    rate0 = min(max(sum(w for _, y, w in cells if y) / max(1e-9, total), 1e-3), 1 - 1e-3)
    model = Boosted(math.log(rate0 / (1 - rate0)))
    splits = sorted({(f, v) for x, *_ in cells for f, v in enumerate(x)})
    score = [model.bias] * len(cells)

    def sums(rows: list[int], g: list[float], h: list[float]) -> tuple[float, float]:
        return sum(g[i] for i in rows), sum(h[i] for i in rows)

    def best(rows: list[int], g: list[float], h: list[float]) -> tuple[float, int, int]:
        found = (-1.0, 0, 99)
        for f, v in splits:
            gain = 0.0
            for part in ([i for i in rows if cells[i][0][f] > v], [i for i in rows if cells[i][0][f] <= v]):
                a, b = sums(part, g, h)
                gain += a * a / (b + 1)
            found = max(found, (gain, f, v))
        return found

    for _ in range(rounds if cells else 0):
        p = [1 / (1 + math.exp(-s)) for s in score]
        g = [w * (y - q) for (_, y, w), q in zip(cells, p, strict=True)]
        h = [w * q * (1 - q) for (*_, w), q in zip(cells, p, strict=True)]
        _, f, v = best(list(range(len(cells))), g, h)
        sides = [[i for i in range(len(cells)) if (cells[i][0][f] > v) == up] for up in (False, True)]
        (_, lf, lv), (_, rf, rv) = (best(side, g, h) for side in sides)
        leaves = []
        for side, (bf, bv) in zip(sides, ((lf, lv), (rf, rv)), strict=True):
            for up in (False, True):
                a, b = sums([i for i in side if (cells[i][0][bf] > bv) == up], g, h)
                leaves.append(rate * a / (b + 1))
        model.trees.append((f, v, lf, lv, rf, rv, tuple(leaves)))
        one = Boosted(0.0, model.trees[-1:])
        score = [s + one.margin(x) for s, (x, *_) in zip(score, cells, strict=True)]
    slope, shift = _calibrated([(model.margin(x), y, w) for x, y, w in held])
    model.bias = model.bias * slope + shift
    model.trees = [(*t[:6], tuple(slope * x for x in t[6])) for t in model.trees]
    thresholds = []
    for kind in range(len(KINDS)):
        own = sorted(((model.margin(x), y, w) for x, y, w in held if x[0] == kind), reverse=True)
        low, good, seen = math.inf, 0.0, 0.0
        for i, (s, y, w) in enumerate(own):
            good, seen = good + w * y, seen + w
            if good >= precision * seen and s > 0 and (i + 1 == len(own) or own[i + 1][0] < s):
                low = s - 1e-9
        thresholds.append(low)
    model.thresholds = tuple(thresholds)
    return model


def _calibrated(scores: list[tuple[float, int, float]]) -> tuple[float, float]:
    """Slope and shift of the logistic curve through the held-out scores (Newton steps with a small ridge towards 1 and 0)."""
    a, b = 1.0, 0.0
    for _ in range(25):
        g = [1e-3 * (a - 1), 1e-3 * b]
        h = [1e-3, 0.0, 1e-3]
        for s, y, w in scores:
            p = 1 / (1 + math.exp(-min(30.0, max(-30.0, a * s + b))))
            g[0], g[1], q = g[0] + w * (p - y) * s, g[1] + w * (p - y), w * p * (1 - p)
            h = [h[0] + q * s * s, h[1] + q * s, h[2] + q]
        det = h[0] * h[2] - h[1] ** 2
        if det < 1e-12:
            break
        da, db = (h[2] * g[0] - h[1] * g[1]) / det, (h[0] * g[1] - h[1] * g[0]) / det
        a, b = max(0.05, a - max(-1.0, min(1.0, da))), b - max(-1.0, min(1.0, db))
    return a, b


def cells_of(found: DataFrame) -> tuple[list[Cell], list[Cell]]:
    """Counts of the labelled candidates by features and label, of either half of the texts. There are at most a few thousand combinations.

    A candidate that meets a base span of its kind is one; then `_labelled` decides; where it doesn't, one that meets other base spans or refused
    ones (of 12 characters at least, if they only look like cards) is none, and the rest teach nothing.
    """
    rows = found.where(F.size("cands") > 0)
    of = lambda spans_, k: F.filter(spans_, lambda s: s["kind"] == k)
    same = F.concat(*(_against(of("cands", k), of("base_", k)) for k in range(len(KINDS))))
    rows = rows.select("half", "planted", F.concat("base_", F.filter("refused", lambda s: (s["kind"] != KINDS.index("card")) | (F.length(s["m"]) >= 12))).alias("others"), same.alias("same"))
    left = _against(F.transform(F.filter("same", lambda y: ~y["met"]), lambda y: y["x"]), F.col("others"))
    one = lambda y, met: F.struct(y["x"].alias("s"), met.alias("is"), y["met"].alias("met"))
    each = F.concat(F.transform(F.filter("same", lambda y: y["met"]), lambda y: one(y, F.lit(True))), F.transform(left, lambda y: one(y, F.lit(False))))
    rows = rows.select("half", "planted", F.explode(each).alias("e")).select("half", "planted", "e.*")
    label = F.coalesce("planted", F.when(F.col("is"), 1).otherwise(_labelled(F.col("s"))), F.when(F.col("met"), 0))
    counts = rows.select("half", F.col("planted").isNotNull().alias("planted"), _described(F.col("s")).alias("x"), label.alias("y")).where(F.col("y").isNotNull()).groupBy("half", "planted", "x", "y").count().collect()
    out: tuple[list[Cell], list[Cell]] = ([], [])
    for r in sorted(counts, key=lambda r: (r.half, (*r.x,), r.y, r.planted)):
        for half in (0, 1) if r.planted else (r.half,):
            out[half].append(((*r.x,), r.y, float(_PLANTED_WEIGHT * r["count"] if r.planted else math.sqrt(r["count"]))))
    return out


def train(found: DataFrame) -> Boosted:
    """Fits on the labelled candidates of one half of the texts, calibrates on the other."""
    return boost(*cells_of(found))


def _order(s: Column) -> Column:
    return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))


def spans(docs: DataFrame, text: str = "text", model: Boosted | None = None) -> DataFrame:
    """Adds base and spans, arrays of (start, kind, end) in order: those of the base patterns, and these with the chosen candidates.

    A null text is empty and has none. Rows are judged alone, so repeated rows get equal spans. Columns of docs stay, whatever their names. The
    texts are searched once: what is found is kept as a table, from which the model learns and the spans are chosen.
    """
    inner = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.col(text).alias("__text"))
    found = _with_spans(inner, "__text")
    if model is None:
        planted = _with_spans(docs.sparkSession.createDataFrame([*PLANTED], "__text string, planted int"), "__text")
        where = docs.columns.index(text)
        names = [f"c{k}" for k in range(len(docs.columns))]
        flat = found.select(*(F.col("__row")[c].alias(n) for c, n in zip(docs.columns, names, strict=True)), "base_", "refused", "cands")
        flat = cut(flat, "found")  # the text once
        row = F.struct(*(F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)))
        found = flat.select(row.alias("__row"), F.coalesce(names[where], F.lit("")).alias("__t"), "base_", "refused", "cands")
        half = F.crc32("__t") % 2
        columns = ["base_", "refused", "cands"]
        model = train(found.select(*columns, half.alias("half"), F.lit(None).cast("int").alias("planted")).unionByName(planted.select(*columns, half.alias("half"), "planted")))
    chosen = F.filter(_free_of(F.col("cands"), F.col("base_")), lambda s: _let(_described(s), model.selects))
    found = found.select("__row", "__t", "base_", F.when(F.size("cands") > 0, chosen).otherwise(F.array().cast(f"array<{_RANKED}>")).alias("more"))
    ranks = F.array(*(F.lit(_FIRST.index(k) + 1) for k in KINDS))
    apart = F.when(F.size("more") > 1, _clear(F.transform("more", lambda s: _ranked(s, F.get(ranks, s["kind"]))), len(KINDS))).otherwise(F.col("more"))
    return found.select("__row", "__t", F.array_sort(F.transform("base_", _order)).alias("base"), F.array_sort(F.concat(F.transform("base_", _order), F.transform(apart, _order))).alias("spans"))


def _joined(spans_: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, a number for each base kind, base_sha256 and spans of each document."""
    found = spans(docs.select("doc_id", "text"))
    kinds = F.transform("base", lambda s: s["kind"])
    n = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{KINDS[k]}") for k in range(len(BASE))]
    return found.select(F.col("__row.doc_id").alias("doc_id"), *n, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, text: str = "text", model: Boosted | None = None) -> DataFrame:
    """docs with each chosen span (overlapping ones as one) replaced by its kind in brackets; n_chars, if there is one, follows. A null text stays."""
    found = spans(docs, text, model)
    tags = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    kind = "struct<start:int,kind:int,opens:boolean,end:int>"

    def made(end, s):
        return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), (s["start"] >= end).alias("opens"), F.greatest(end, s["end"]).alias("end"))

    run = _scanned(F.col("spans"), F.lit(0), lambda end, s: F.greatest(end, s["end"]), made, kind)
    # overlapping spans are one: it begins where a span opens, and ends as far as any got before the next opens
    ends = _let(run, lambda r: F.filter(F.transform(r, lambda s, i: F.when(F.coalesce(F.get(r, i + 1)["opens"], F.lit(True)), s["end"])), lambda e: e.isNotNull()))
    opens = F.filter(run, lambda s: s["opens"])
    merged = F.zip_with(opens, ends, lambda s, e: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), e.alias("end")))
    some = F.size("spans") > 0
    found = found.select("__row", "__t", F.when(some, merged).alias("merged"), F.when(some, F.regexp_extract_all("__t", F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))).alias("chunks"))

    def part(lo, hi):  # characters lo to hi, from the chunks they lie in
        a, b = F.floor(lo / _CHUNK).cast("int"), F.floor((hi - 1) / _CHUNK).cast("int")
        ends = F.concat(F.substring(F.get("chunks", a), lo % _CHUNK + 1, F.lit(_CHUNK)), F.array_join(F.slice("chunks", a + 2, F.greatest(b - a - 1, F.lit(0))), ""), F.substring(F.get("chunks", b), F.lit(1), hi - b * _CHUNK))
        return F.when(hi <= lo, "").when(a == b, F.substring(F.get("chunks", a), lo % _CHUNK + 1, hi - lo)).otherwise(ends)

    def pieces(spans_):
        return F.array_join(F.transform(spans_, lambda s, i: F.concat(part(F.when(i > 0, F.get(spans_, i - 1)["end"]).otherwise(0), s["start"]), F.get(tags, s["kind"]))), "")

    tail = part(F.try_element_at("merged", F.lit(-1))["end"], F.length("__t"))
    new = F.when(F.size("merged") > 0, F.concat(_let(F.col("merged"), pieces), tail)).otherwise(F.col(f"__row.`{text}`"))
    found = found.select("__row", new.alias("__new"))
    kinds = {f.name: f.dataType for f in docs.schema}
    return found.select(*(F.col("__new").alias(c) if c == text else F.coalesce(F.length("__new").cast(kinds[c]), F.col(f"__row.`{c}`")).alias(c) if c == "n_chars" else F.col(f"__row.`{c}`").alias(c) for c in docs.columns))
