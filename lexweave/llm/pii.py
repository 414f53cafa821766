"""Personal data: candidate spans scored by boosted trees; DataFrame functions only.

Generators of high recall, several a kind, propose overlapping spans beside the strict forms
(the base). Each candidate that touches no base span gets features of its format and context.
Boosted trees are fitted on texts that a seeded generator writes into contexts of the corpus:
personal data in forms that the strict ones miss (written-out signs, other separators, national
numbers) and look-alikes (dates, amounts, serial numbers, prose), so that each candidate's label
is known. An isotonic calibration on a fold that the trees haven't seen turns their odds into
probabilities, and a threshold on these selects, kind by kind, what is added to the base. The
trees become one Column expression; a row's whole way is a projection: no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import give_back, unused
from lexweave.llm.quality import pooled

KINDS = ("email", "ip", "card", "phone")
#: Strict forms. As the plain patterns of the contract, but each repeated class is possessive and
#: begins at its run's start, so that a long run of characters is read once.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of each kind: written-out signs in addresses, other separators or none, national forms.
LOOSE = {
    "email": (
        r"[A-Za-z0-9._%+-]{1,64}+ ?(?:@|[(\[{]at[)\]}]) ?[A-Za-z0-9-]{1,64}+(?: ?(?:\.|[(\[{]dot[)\]}]) ?[A-Za-z0-9-]{2,24}+)+",
        r"[A-Za-z0-9._%+-]{1,64}+ ?(?:@|[(\[{]at[)\]}]) ?[A-Za-z0-9-]{1,64}+(?:(?:\.| ?[(\[{]dot[)\]}] ?)[A-Za-z0-9-]{2,24}+)+",
        r"[A-Za-z0-9._%+-]{1,64}+ (?:at|AT) [A-Za-z0-9-]{1,64}+(?: (?:dot|DOT) [A-Za-z0-9-]{2,24}+)+",
    ),
    "ip": (
        r"(?<![0-9])[0-9]{1,3}(?:(?:\.|,|[(\[{]\.[)\]}])[0-9]{1,3}){3}(?![0-9])",
        r"(?<![0-9])[0-9]{1,3}(?: ?(?:[(\[{]dot[)\]}]|dot|DOT) ?[0-9]{1,3}){3}(?![0-9])",
        r"(?<![0-9-])[0-9]{1,3}(?:-[0-9]{1,3}){3}(?![0-9-])",
    ),
    "card": (
        r"(?<![0-9])[0-9]{4}(?:[^0-9A-Za-z\n]{1,3}[0-9]{4}){2}[^0-9A-Za-z\n]{1,3}[0-9]{1,7}(?![0-9])",
        r"(?<![0-9])[0-9]{4}[^0-9A-Za-z\n]{1,3}[0-9]{6}[^0-9A-Za-z\n]{1,3}[0-9]{4,5}(?![0-9])",
        r"(?<![0-9])[0-9]{12,19}(?![0-9])",
    ),
    "phone": (
        r"(?<![0-9+])(?:00|\()?[0-9][0-9\x20()./-]{7,20}[0-9](?![0-9])",
        r"(?<![0-9+])\(?0[1-9][0-9]{1,4}\)?[\x20/-]{1,3}[0-9]{2,8}(?:[\x20-][0-9]{2,4}){0,3}(?![0-9])",
        r"(?<![0-9+])\(?[2-9][0-9]{2}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
        r"(?<![0-9+])00[1-9][0-9]{0,2}[\x20./-]?(?:\(0?[0-9]{1,4}\)[\x20./-]?)?[0-9](?:[\x20./-]?[0-9]){5,12}(?![0-9])",
    ),
}
#: Characters of context before and after a candidate.
BEFORE, AFTER = 32, 8
#: Words that stand near personal data, and near numbers of other kinds. Fixed values.
CUES = {
    "email": "mail|contact|write|reach|schreib|courriel|correo|kontakt|escrib",
    "ip": "ip|server|host|address|addr|login|adresse|servidor|node|ping",
    "card": "card|visa|credit|pay|karte|carte|tarjeta|account",
    "phone": "phone|call|tel|mobile|fax|dial|anruf|ruf|appel|llam|mobil|handy",
}
OTHERS = "order|serial|part|isbn|item|ticket|invoice|version|vol|page|year|from|between|total|price|section|chapter|bestell|seite|jahr"
#: The ends of mail hosts that are known by name. Fixed values.
ENDS = "com|org|net|edu|gov|info|io|co|de|fr|es|it|uk|eu|at|ch|example|test"
#: Texts that are written for fitting, and texts of the corpus that lend them contexts; the boosting's parameters.
WRITTEN, LENDERS, ROUNDS, RATE, LEAF = 4000, 200, 40, 0.3, 10
#: What is added has at least this calibrated probability.
PROBABILITY = 0.9


def luhn(digits: Column) -> Column:
    """Whether the digits (at most 19) pass the Luhn check."""
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n), F.lit(0),
        lambda acc, i: acc + F.when((n - i) % 2 == 1, F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), F.substring(digits, i, F.lit(1)).cast("int") + 1)).otherwise(F.substring(digits, i, F.lit(1)).cast("int")),
    )
    return total % 10 == 0


def passes(kind: str, match: Column) -> Column:
    """What a strict match must fulfil besides its form."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])?"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(9, 15)
    right = F.length(digits).between(12, 19)
    return F.when(right, luhn(F.when(right, digits).otherwise("0"))).otherwise(False)


def _check(kind: str):
    return lambda c: passes(kind, c["match"])


def _before(sizes: Column) -> Column:
    """The sum of all sizes before each; in blocks, so that many matches don't cost their square."""
    block, n = 256, F.size(sizes)
    add = lambda a, x: a + x
    zero = F.lit(0).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")), lambda b: F.aggregate(F.slice(sizes, b * block + 1, F.lit(block)), zero, add))
    pair = F.struct(sizes.alias("s"), blocks.alias("b"))
    return F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.aggregate(F.slice(pair["b"], F.lit(1), F.floor(i / block).cast("int")), zero, add) + F.aggregate(F.slice(pair["s"], F.floor(i / block).cast("int") * block + 1, i % block), zero, add),
    )


def _matches(rows: DataFrame, patterns: dict[str, tuple[str, str]]) -> DataFrame:
    """For each name (column of texts, pattern) adds name: array of (start, end, match, before, after) in code points, leftmost and not overlapping.

    Between the pieces that split() leaves lie the matches, in order; so a match starts after the
    lengths of all pieces and matches before it.
    """
    of = {out: unused(rows.columns, *(f"{out}_{k}" for k in ("m", "p", "l", "s"))) for out in patterns}
    some = lambda out, then, other: F.when(F.size(of[out][0]) > 0, then).otherwise(other)
    rows = rows.withColumns({of[out][0]: F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)) for out, (text, pattern) in patterns.items()})
    rows = rows.withColumns({of[out][1]: some(out, F.split(F.col(text), pattern, -1), F.array(F.lit(""))) for out, (text, pattern) in patterns.items()})
    rows = rows.withColumns({n[2]: F.zip_with(F.slice(F.col(n[1]), F.lit(1), F.size(n[0])), F.col(n[0]), lambda p, m: F.length(p) + F.length(m)) for n in of.values()})
    rows = rows.withColumns({of[out][3]: some(out, _before(F.col(of[out][2])), F.array().cast("array<int>")) for out in patterns})
    empty = F.array().cast("array<struct<start:int,end:int,match:string,before:string,after:string>>")

    def found(matches: str, pieces: str, starts: str) -> Column:
        def row(i: Column) -> Column:
            gap, match = F.element_at(F.col(pieces), i + 1), F.element_at(F.col(matches), i + 1)
            start, after = F.element_at(F.col(starts), i + 1) + F.length(gap), F.left(F.element_at(F.col(pieces), i + 2), F.lit(AFTER))
            return F.struct(start.alias("start"), (start + F.length(match)).alias("end"), match.alias("match"), F.right(gap, F.lit(BEFORE)).alias("before"), after.alias("after"))

        return F.transform(F.sequence(F.lit(0), F.size(matches) - 1), row)

    rows = rows.withColumns({out: some(out, found(n[0], n[1], n[3]), empty) for out, n in of.items()})
    return rows.drop(*(x for n in of.values() for x in n))


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds base_<kind> (checked strict spans) and loose_<kind> (all proposals, strict matches that fail too).

    A span that several generators propose is there once, with the longest of its contexts. docs
    has no columns that begin with base_, loose_ or __.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    mail = F.contains(whole, F.lit("@")) | whole.rlike(r"[(\[{]at[)\]}]|(?i: at [a-z0-9-]++ dot )")
    rows = docs.withColumns({"__digit": F.when(whole.rlike("[0-9]"), whole).otherwise(""), "__at": F.when(mail, whole).otherwise("")})
    source = {kind: "__at" if kind == "email" else "__digit" for kind in KINDS}
    patterns = {f"__base_{kind}": (source[kind], BASE[kind]) for kind in KINDS}
    patterns |= {f"__loose_{kind}{k}": (source[kind], p) for kind in KINDS for k, p in enumerate(LOOSE[kind])}
    rows = _matches(rows, patterns)
    rows = rows.withColumns({f"base_{kind}": F.filter(F.col(f"__base_{kind}"), _check(kind)) for kind in KINDS})
    every = {kind: [n for n in patterns if n.startswith((f"__base_{kind}", f"__loose_{kind}"))] for kind in KINDS}
    rows = rows.withColumns({f"__all_{kind}": F.array_sort(F.transform(F.concat(*every[kind]), _by_place)) for kind in KINDS})
    rows = rows.withColumns({f"loose_{kind}": F.filter(F.col(f"__all_{kind}"), _new_span(f"__all_{kind}")) for kind in KINDS})
    return rows.drop("__digit", "__at", *patterns, *(f"__all_{kind}" for kind in KINDS))


def _by_place(c: Column) -> Column:
    """The match so that sorting puts equal spans side by side, the one with the longest context first."""
    context = (-F.length(c["before"]) - F.length(c["after"])).alias("context")
    return F.struct(c["start"].alias("start"), c["end"].alias("end"), context, c["match"].alias("match"), c["before"].alias("before"), c["after"].alias("after"))


def _new_span(ordered: str) -> Callable[[Column, Column], Column]:
    def new(c: Column, i: Column) -> Column:
        last = F.try_element_at(F.col(ordered), F.greatest(i, F.lit(1)))
        return (i == 0) | (last["start"] != c["start"]) | (last["end"] != c["end"])

    return new


def free(kind: str) -> Column:
    """The proposals of the kind that touch no base span: what lies within one adds nothing."""

    def apart(c: Column) -> Column:
        email, ip, card, phone = (F.exists(F.col(f"base_{k}"), lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])) for k in KINDS)
        return ~(email | ip | card | phone)

    return F.filter(F.col(f"loose_{kind}"), apart)


#: Features of a candidate, by name; format first, then context.
FEATURES = (
    "length", "digits", "signs", "groups", "sign kinds", "spaces", "brackets", "same digit", "letters", "leading zero", "first group", "last group", "valid", "thousands", "year",
    "cue", "other cue", "colon", "in word", "sign before", "sign after", "kind",
)


def valid(kind: str, match: Column, digits: Column) -> Column:
    """Whether the candidate, whatever its separators, has what its kind must have."""
    if kind == "email":
        return match.rlike(rf"(?i)(?:\.|dot[)\]}}]?) ?(?:{ENDS})$")
    if kind == "ip":
        part = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
        return match.rlike(rf"^{part}(?:[^0-9]+{part}){{3}}$")
    if kind == "card":
        right = F.length(digits).between(12, 19)
        return F.when(right, luhn(F.when(right, digits).otherwise("0"))).otherwise(False)
    return F.length(digits).between(9, 13)


def features(kind: str, c: Column) -> list[Column]:
    match, before, after = c["match"], F.lower(c["before"]), c["after"]
    digits, groups, signs = F.regexp_replace(match, "[^0-9]", ""), F.split(match, "[^A-Za-z0-9]+"), F.regexp_extract_all(match, F.lit("[^A-Za-z0-9]+"), F.lit(0))
    group = lambda at: F.length(F.coalesce(F.try_element_at(F.filter(groups, lambda g: g != ""), F.lit(at)), F.lit("")))
    return [x.cast("double") for x in (
        F.length(match), F.length(digits), F.length(F.array_join(signs, "")), F.size(groups), F.size(F.array_distinct(signs)), F.length(match) - F.length(F.replace(match, F.lit(" "), F.lit(""))),
        match.rlike(r"[(\[{]").cast("int"), match.rlike(r"([0-9])(?:[^0-9]*\1){6}").cast("int"), F.length(match) - F.length(F.regexp_replace(match, "[A-Za-z]", "")), match.rlike(r"^\(?0").cast("int"),
        group(1), group(-1), valid(kind, match, digits).cast("int"), match.rlike(r"^[0-9]{1,3}(?:[,. ][0-9]{3})+$").cast("int"), match.rlike(r"(?:^|[^0-9])(?:19|20)[0-9]{2}(?:[^0-9]|$)").cast("int"),
        before.rlike(CUES[kind]).cast("int"), before.rlike(OTHERS).cast("int"), before.rlike(r"[:=]\s*$").cast("int"), (before.rlike("[a-z0-9]$") | after.rlike("^[A-Za-z0-9]")).cast("int"),
        before.rlike(r"[#$€£%§+*/_-]\s?$").cast("int"), after.rlike(r"^\s?[$€£%°*/_-]").cast("int"), F.lit(KINDS.index(kind)),
    )]


@dataclass
class Trees:
    """Trees of two levels: (feature, cut, feature and cut below, feature and cut above, four values).

    thresholds: by kind the lowest odds that are selected; figures: by kind (precision, recall)
    on the written texts of a fold that neither trees nor thresholds have seen.
    """

    trees: list[tuple] = field(default_factory=list)
    start: float = -6.0
    thresholds: dict[str, float] = field(default_factory=dict)
    figures: dict[str, tuple[float, float]] = field(default_factory=dict)

    def odds(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        for f, c, (f0, c0), (f1, c1), v in self.trees:
            z += np.where(x[:, f] <= c, np.where(x[:, f0] <= c0, v[0], v[1]), np.where(x[:, f1] <= c1, v[2], v[3]))
        return z

    def column(self, x: list[Column]) -> Column:
        z = F.lit(self.start)
        for f, c, (f0, c0), (f1, c1), v in self.trees:
            below = F.when(x[f0] <= c0, F.lit(v[0])).otherwise(F.lit(v[1]))
            z = z + F.when(x[f] <= c, below).otherwise(F.when(x[f1] <= c1, F.lit(v[2])).otherwise(F.lit(v[3])))
        return z


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, int, float]:
    """(gain, feature, cut) of the best cut by gradients and curvatures."""
    best, all_ = (0.0, 0, np.inf), g.sum() ** 2 / (h.sum() + 1)
    for f in range(x.shape[1]):
        values, at = np.unique(x[:, f], return_inverse=True)
        sums, curves, many = (np.cumsum(np.bincount(at, w, len(values))) for w in (g, h, np.ones(len(g))))
        ok = (many[:-1] >= LEAF) & (many[-1] - many[:-1] >= LEAF)
        gain = np.where(ok, sums[:-1] ** 2 / (curves[:-1] + 1) + (sums[-1] - sums[:-1]) ** 2 / (curves[-1] - curves[:-1] + 1) - all_, 0)
        if len(gain) and gain.max() > best[0]:
            k = int(gain.argmax())
            best = float(gain[k]), f, float((values[k] + values[k + 1]) / 2)
    return best


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Gradient boosting of the logistic loss with trees of two levels."""
    model = Trees()
    if not len(y) or y.min() == y.max():
        return model if not len(y) or not y.max() else Trees(start=0.0)
    model.start = float(np.log(y.mean() / (1 - y.mean())))
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-model.odds(x)))
        g, h = y - p, p * (1 - p)
        gain, f, c = _split(x, g, h)
        if gain <= 1e-6:
            break
        low = x[:, f] <= c
        _, f0, c0 = _split(x[low], g[low], h[low])
        _, f1, c1 = _split(x[~low], g[~low], h[~low])
        leaves = [low & (x[:, f0] <= c0), low & (x[:, f0] > c0), ~low & (x[:, f1] <= c1), ~low & (x[:, f1] > c1)]
        model.trees.append((f, c, (f0, min(c0, 1e18)), (f1, min(c1, 1e18)), tuple(float(RATE * g[k].sum() / (h[k].sum() + 1)) for k in leaves)))
    return model


def _luhn_end(digits: str) -> str:
    """The digit that makes the digits a right card number."""
    total = sum(2 * int(d) - 9 * (int(d) > 4) if k % 2 == 0 else int(d) for k, d in enumerate(reversed(digits)))
    return str(-total % 10)


class Writer:
    """Writes texts with personal data in forms that the strict ones miss, and with look-alikes, in given contexts."""

    def __init__(self, contexts: list[list[str]], seed: int = 17):
        self.r, self.contexts = np.random.default_rng(seed), [c for c in contexts if c] or [["some", "plain", "words", "of", "prose"]]

    def one(self, *of):
        return of[int(self.r.integers(0, len(of)))]

    def digits(self, n: int, first: str = "123456789") -> str:
        return self.one(*first) + "".join(map(str, self.r.integers(0, 10, n - 1)))

    def word(self) -> str:
        own = "".join(c for c in self.one(*self.one(*self.contexts)).lower() if c.isascii() and c.isalpha())
        return own or self.one("anna", "team", "north", "info", "mail")

    def email(self, real: bool) -> str:
        user = self.one(self.word(), f"{self.word()}.{self.word()}", f"{self.word()}{self.digits(2)}", f"{self.word()}_{self.word()}")
        host, end = self.one(self.word(), f"{self.word()}-{self.word()}", "mail"), self.one("com", "org", "net", "de", "fr", "es", "io", "info", "co", "example")
        if real:
            a, b = self.one("(", "[", "{"), self.one(" ", "")
            close = {"(": ")", "[": "]", "{": "}"}[a]
            at, dot = f"{b}{a}at{close}{b}", f"{b}{a}dot{close}{b}"
            extra = self.one("", "", f"{self.word()}{dot}")
            return self.one(f"{user}{at}{extra}{host}{dot}{end}", f"{user}{at}{extra}{host}{dot}{end}", f"{user}{at}{host}.{end}", f"{user} at {host} dot {end}", f"{user} @ {host}.{end}")
        return self.one(
            f"{self.word()} at {host} dot {self.word()}", f"{self.digits(2)} @ {self.digits(1)}.{self.digits(2)}", f"{self.word()} @ {host}", f"@{user}. {self.word()}", f"{self.word()} @ {host}. {self.word()}",
            f"{self.word()} (at) {host}. {self.word()}", f"{self.word()} @{host}.{self.word()}", f"{self.digits(3)} [at] {self.digits(2)}.{self.digits(2)}",
        )

    def ip(self, real: bool) -> str:
        parts = [str(x) for x in self.r.integers(1, 256, 4)]
        sign = self.one("[.]", "(.)", "(dot)", "[dot]", " dot ", "-", ",", "[.]")
        if real:
            return sign.join(parts)
        return self.one(
            f"{self.digits(1)},{self.digits(3)},{self.digits(3)},{self.digits(3)}", "-".join(self.digits(2) for _ in range(4)), ",".join(self.digits(1) for _ in range(4)), ",".join(self.digits(2) for _ in range(4)),
            sign.join([*parts[:3], str(self.r.integers(256, 999))]), "-".join(self.digits(3) for _ in range(4)), "-".join(map(str, range(int(parts[0]) % 7, int(parts[0]) % 7 + 4))), ",".join(self.digits(3) for _ in range(4)),
        )

    def card(self, real: bool) -> str:
        short = self.r.random() < 0.3
        body = ("37" if short else self.one("4", "51", "52", "6011")) + self.digits(20)
        body = body[: 14 if short else 15]
        end = _luhn_end(body)
        number = body + (end if real else str((int(end) + int(self.r.integers(1, 10))) % 10))
        cuts = (0, 4, 10, 15) if short else (0, 4, 8, 12, 16)
        sign = self.one(".", "_", "/", " - ", "--", "*", ":", ". ", "|", " / ") if real or self.r.random() < 0.7 else self.one("", " ", "-")
        return sign.join(number[a:b] for a, b in zip(cuts, cuts[1:], strict=False))

    def phone(self, real: bool) -> str:
        d = self.digits
        if real:
            return self.one(
                f"(0{d(2)}) {d(3)}{d(4)}", f"(0{d(3)}) {d(3)}-{d(4)}", f"0{d(2)}/{d(7)}", f"0{d(3)} {d(3)} {d(2)} {d(2)}", f"0{d(2)}-{d(3)} {d(2)} {d(2)}", f"0{d(3)} {d(7)}", f"({d(3, '23456789')}) {d(3)}-{d(4)}",
                f"{d(3, '23456789')}-{d(3)}-{d(4)}", f"{d(3, '23456789')}.{d(3)}.{d(4)}", f"00{d(2)} {d(2)} {d(7)}", f"00{d(2)}-{d(3)}-{d(3)}-{d(4)}", f"00{d(2)} ({d(2)}) {d(3)} {d(4)}",
            )
        year, month, day = self.one("19", "20") + d(2), f"{self.r.integers(1, 13):02d}", f"{self.r.integers(1, 29):02d}"
        return self.one(
            f"{year}-{month}-{day} {d(2, '01')}{d(2)}", f"{day}.{month}.{year} - {day}.{month}.{year}", f"{year} - {year} {year}", f"{d(3)} {d(3)} {d(3)}", f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"10.{d(4)}/{d(3)}.{d(4)}",
            " ".join(d(2) for _ in range(int(self.r.integers(4, 8)))), d(int(self.r.integers(9, 12))), f"{d(2)}/{d(2)}/{year} {d(2)}", f"{d(3)}.{d(3)}.{d(3)}", f"{year}/{year} {d(3)}", f"{d(5)}-{d(5)}", f"{d(4)} {d(4)} {d(4)}",
            f"{year}{month}{day}", f"000{d(7)}", f"{d(1)}.{d(3)}.{d(3)} {d(3)}", f"{d(4)}-{d(4)}", f"{month}/{year} {day}/{year}",
        )

    def text(self) -> tuple[str, list[tuple[str, int, int]]]:
        """A text, and the personal data in it: (kind, start, end)."""
        out, planted = "", []
        for _ in range(int(self.r.integers(1, 4))):
            words, kind, real = self.one(*self.contexts), self.one(*KINDS), self.r.random() < 0.5
            at = int(self.r.integers(0, len(words) + 1))
            out += " ".join(words[max(0, at - 12) : at]) + " "
            cue = self.r.random()
            if cue < (0.7 if real else 0.15):
                out += self.one(*(c for c in CUES[kind].split("|") if len(c) > 3)) + self.one(" ", ": ", " is ", " at ", " = ", ", ")
            elif cue > (0.97 if real else 0.6):
                out += self.one(*OTHERS.split("|")) + self.one(" ", ": ", " no. ", " #", " of ")
            elif not real and self.r.random() < 0.2:
                out += self.one("$", "€ ", "v", "No. ", "#")
            form = getattr(self, kind)(real)
            if real:
                planted.append((kind, len(out), len(out) + len(form)))
            out += form + self.one(". ", ", ", " ", "; ", "! ", "\n", ") ") + " ".join(words[at : at + 12]) + " "
        return out, planted


def contexts(docs: DataFrame, most: int = LENDERS, words: int = 40) -> list[list[str]]:
    """Passages of at most `words` words of `most` texts, the first by a hash of the text, from a place that the hash chooses."""
    listed = F.split(F.coalesce(F.col("text"), F.lit("")), r"[\x20\x09-\x0D]+")
    place = F.pmod(F.xxhash64("text"), F.greatest(F.size(listed) - words, F.lit(1))) + 1
    # of 2^30 hash values so many that some eight times `most` texts are left to sort, whatever the number of all
    share = min(1 << 30, (8 * most << 30) // max(1, docs.count()) + 1)
    few = docs.select("text").filter(F.pmod(F.xxhash64("text", F.lit(2)), F.lit(1 << 30)) < share)
    passages = few.select(F.xxhash64("text", F.lit(1)).alias("place"), F.transform(F.slice(listed, place.cast("int"), words), lambda w: F.left(w, F.lit(24))).alias("words"))
    passages = passages.orderBy("place", "words").limit(most)
    # no digits and signs of addresses: the numbers of the contexts themselves have no label
    return sorted([w for w in r["words"] if w and not any(c in "0123456789@()[]{}" for c in w)] for r in passages.collect())


def _example(k: int) -> Callable[[Column], Column]:
    return lambda c: F.struct(F.array(*features(KINDS[k], c)).alias("x"), F.lit(k).alias("kind"), c["start"].alias("start"), c["end"].alias("end"))


def fit(docs: DataFrame, written: int = WRITTEN) -> Trees:
    """Fits on `written` texts of a seeded generator, in contexts of at most LENDERS texts of docs.

    A candidate's label is whether the generator planted exactly this span of its kind. Of five
    texts three fit the trees, one the calibration, from which the thresholds come, and one the
    figures. An empty table lends no context; the fit is as good as without.
    """
    writer = Writer(contexts(docs))
    texts = [writer.text() for _ in range(written)]
    planted = {(i, *span) for i, (_, spans_) in enumerate(texts) for span in spans_}
    rows = candidates(docs.sparkSession.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc long, text string"))
    parts = [F.transform(free(kind), _example(k)) for k, kind in enumerate(KINDS)]
    found = sorted((r["doc"], c["kind"], c["start"], c["end"], c["x"]) for r in rows.select("doc", F.concat(*parts).alias("found")).collect() for c in r["found"])
    x = np.array([f[4] for f in found]).reshape(-1, len(FEATURES))
    y = np.array([(i, KINDS[k], a, b) in planted for i, k, a, b, _ in found], float)
    fold, kinds = np.array([f[0] for f in found], int) % 5, np.array([f[1] for f in found], int)
    model = boost(x[fold < 3], y[fold < 3])
    z = model.odds(x)
    for k, kind in enumerate(KINDS):
        own, unseen = (fold == 3) & (kinds == k), (fold == 4) & (kinds == k)
        cut = threshold(z[own], y[own])
        if cut is not None:
            model.thresholds[kind] = cut
            selected, hits = unseen & (z >= cut), sum(1 for i, name, _, _ in planted if i % 5 == 4 and name == kind)
            model.figures[kind] = float(y[selected].sum() / max(1, selected.sum())), float(y[selected].sum() / max(1, hits))
    del texts, planted, found, x, y
    give_back()
    return model


def threshold(odds: np.ndarray, label: np.ndarray, probability: float = PROBABILITY) -> float | None:
    """The lowest of the odds whose isotonic probability, with a pseudo-count of either class, reaches the bound, or None."""
    return next((low for y, _, n, low in pooled(odds, label) if (y + 0.5) / (n + 1) >= probability), None)


def _selected(kind: str, model: Trees) -> Column:
    """The free proposals that the trees select. Features are computed once each, not once a tree."""
    rows = F.transform(free(kind), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.array(*features(kind, c)).alias("x")))
    return F.filter(rows, lambda c: model.column([c["x"][i] for i in range(len(FEATURES))]) >= model.thresholds[kind])


def spans(docs: DataFrame, model: Trees) -> DataFrame:
    """docs with base and spans: arrays of (start, kind number, end), each ascending and distinct.

    Null and empty texts have none. Repeated rows are scanned each; extra columns stay, of which
    none may be called base or spans or begin with base_, loose_ or __. An empty table stays so.
    """
    rows = candidates(docs)
    plain = lambda kind: lambda c: F.struct(c["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), c["end"].alias("end"))
    base = F.concat(*(F.transform(F.col(f"base_{k}"), plain(k)) for k in KINDS))
    added = [F.transform(_selected(k, model), plain(k)) for k in KINDS if k in model.thresholds]
    rows = rows.withColumn("base", F.array_sort(base))
    rows = rows.withColumn("spans", F.array_sort(F.array_distinct(F.concat(F.col("base"), *added))))
    # a filter or explode on what follows stops here: pushed further it would run all patterns once more for each mention
    return rows.withColumns({c: _barred(c) for c in ("base", "spans")}).drop(*(f"{p}_{k}" for p in ("base", "loose") for k in KINDS))


def _barred(name: str) -> Column:
    """The column; never computed twice nor moved, as Spark leaves expressions with a random part in their place."""
    return F.when(F.rand(0) >= 0, F.col(name))


def described(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def _of_kind(k: int):
    return lambda s: s["kind"] == k


def report(docs: DataFrame, model: Trees) -> DataFrame:
    """doc_id, counts of base spans by kind, and the base and all spans described."""
    rows = spans(docs.select("doc_id", "text"), model)
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(described(F.col("base")), 256).alias("base_sha256"), described(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, model: Trees) -> DataFrame:
    """docs, all columns, with each maximal run of overlapping spans replaced by its first kind in brackets; n_chars follows the text."""
    columns = docs.columns
    names = {c: f"__own{k}" for k, c in enumerate(columns) if c != "text" and (c in ("base", "spans") or c.startswith(("base_", "loose_", "__")))}
    rows = spans(docs.withColumnsRenamed(names), model)
    item = "struct<start:int,kind:int,end:int>"
    runs = F.aggregate(
        F.col("spans"), F.array().cast(f"array<{item}>"),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0)) > s["start"]), F.concat(
            F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))),
            F.array(F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"), F.try_element_at(acc, F.lit(-1))["kind"].alias("kind"), F.greatest(F.try_element_at(acc, F.lit(-1))["end"], s["end"]).alias("end"))),
        )).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))),
    )
    rows = rows.withColumn("__runs", runs)
    names_of = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    piece = lambda r, i: F.concat(F.substring(F.col("text"), F.when(i == 0, F.lit(0)).otherwise(F.try_element_at(F.col("__runs"), i)["end"]) + 1, r["start"] - F.when(i == 0, F.lit(0)).otherwise(F.try_element_at(F.col("__runs"), i)["end"])), F.element_at(names_of, r["kind"] + 1))
    rest = F.substring(F.col("text"), F.try_element_at(F.col("__runs"), F.lit(-1))["end"] + 1, F.length("text"))
    rows = rows.withColumn("__clean", F.when(F.size("__runs") == 0, F.col("text")).otherwise(F.concat(F.array_join(F.transform("__runs", piece), ""), rest)))
    out = rows.withColumn("text", F.col("__clean"))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.size("__runs") == 0, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    out = out.drop("base", "spans", "__runs", "__clean").withColumnsRenamed({v: k for k, v in names.items()})
    return out.select(*[f"`{c}`" for c in columns])
