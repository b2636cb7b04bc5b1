"""Personal data with DataFrame functions alone: patterns propose spans, checksums confirm them, context words adjust scores.

Kinds, in the order in which spans are listed:

- ``email``, ``ip`` (four parts of at most 255), ``card`` (16 to 19 digits that pass Luhn), ``phone`` (with ``+``, 8 to
  15 digits): found by pattern and rule alone, whatever their score;
- added to these from a score of ``LEAST`` on: ``card`` of 13 to 15 digits that pass Luhn, ``phone`` without ``+``, ``iban``
  (mod 97) and ``ssn`` (a valid area, group and serial). The first two and ``ssn`` need a context word; an added span
  that meets one listed before it is left out.

A span's score is its kind's prior, ``STEP`` more with a word of its kind near, ``STEP`` less with a word that speaks
against it, within 0 and 100. Near are the ``BEFORE`` code points before the span and the ``AFTER`` behind it, no
further than the next candidate of the kind. Matches of one kind don't overlap; one that fails its rule is dropped and not
tried again inside. Places are code points, ends exclusive.

The patterns take a run of digits or address characters from its start only and never give characters back, so a long
run costs its length once and no stack. Places are sums of the lengths of what stands between matches, made block by block, so
that a text of very many matches costs no square of them.

A null or empty text has no spans. Rows with a null doc_id, repeated rows and texts of any length come out each with
their own; an empty table gives no rows. Further columns, whatever their names, are not read by ``spans`` and returned by
``redacted``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
LEAST, STEP, BEFORE, AFTER = 60, 30, 40, 24
#: Matches whose places are summed up at once.
BLOCK = 256

#: Context words by kind, in four languages, A-Z in lower case.
NEAR = {
    "email": ("email", "mail", "contact", "write", "kontakt", "courriel", "correo"),
    "ip": ("ip", "address", "host", "server", "adresse", "direccion"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "karte", "kreditkarte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "telephone", "call", "mobile", "fax", "telefon", "anruf", "appelez", "telefono", "llame"),
    "iban": ("iban", "account", "bank", "konto", "compte", "banque", "cuenta", "banco"),
    "ssn": ("ssn", "social security", "taxpayer"),
}
AGAINST = ("version", "build", "sample", "order", "invoice", "isbn", "serial", "tracking")


@dataclass(frozen=True)
class Rule:
    """A pattern with what its matches must fulfil. ``base`` matches need no score."""

    kind: str
    pattern: str
    prior: int
    base: bool
    valid: Callable[[Column], Column]


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _count(match: Column, least: int, most: int) -> Column:
    return F.length(_digits(match)).between(least, most)


def _small_parts(match: Column) -> Column:
    number = lambda part: F.ltrim(part, F.lit("0"))
    return F.forall(F.split(match, r"\."), lambda p: (F.length(number(p)) < 3) | ((F.length(number(p)) == 3) & (number(p) <= "255")))


def mod97(match: Column) -> Column:
    """The remainder that is 1 for a valid account number: its first four characters go last, letters count from 10."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda left, c: F.when(c == "", left).otherwise((left * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97))


#: Runs of digits with single separators, from their start to their end.
_RUN = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){%d,%d}(?![\x20-]?[0-9])"
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"

RULES = (
    Rule("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++", 90, True, lambda m: F.lit(True)),
    Rule("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", 70, True, _small_parts),
    Rule("card", _RUN % (15, 18), 90, True, lambda m: F.call_function("luhn_check", _digits(m))),
    Rule("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 70, True, lambda m: _count(m, 8, 15)),
    Rule("card", _RUN % (12, 14), 45, False, lambda m: F.call_function("luhn_check", _digits(m))),
    Rule("phone", r"(?:\([0-9]{3}\) ?|(?<![A-Za-z0-9_])[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![A-Za-z0-9_])", 40, False, lambda m: F.lit(True)),
    Rule("iban", r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{0,2}[0-9])?(?![A-Za-z0-9_])", 95, False, lambda m: mod97(m) == 1),
    Rule(
        "ssn", r"(?<![A-Za-z0-9_])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_])", 40, False,
        lambda m: ~m.rlike("^(000|666|9)|-00-|-0000$"),
    ),
)

_SPAN = "array<struct<kind:string,start:bigint,end:bigint,score:int,base:boolean>>"


def said(words: tuple[str, ...]) -> str:
    """A pattern for a text that has one of the words."""
    other = r"[^a-z\x{80}-\x{10FFFF}]"
    return f"(^|{other})({'|'.join(words)})({other}|$)"


def _starts(gaps: Column, matches: Column) -> Column:
    """The place of each match: the lengths of all gaps up to it, and of all matches before it."""
    def summed(lengths: Column, first: Column) -> Column:
        """For each value, ``first`` and all values before it."""
        empty = F.array().cast("array<bigint>")
        step = lambda s, x: F.struct((s["at"] + x).alias("at"), F.array_append(s["before"], s["at"]).alias("before"))
        return F.aggregate(lengths, F.struct(first.alias("at"), empty.alias("before")), step, lambda s: s["before"])

    lengths = F.transform(matches, lambda m, k: (F.length(F.get(gaps, k)) + F.length(m)).cast("long"))
    count = F.floor((F.size(matches) - 1) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), count), lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)))
    totals = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v))
    heads = summed(totals, F.lit(0).cast("long"))
    before = F.flatten(F.transform(F.arrays_zip(blocks.alias("x"), heads.alias("at")), lambda b: summed(b["x"], b["at"])))
    return F.transform(before, lambda at, k: at + F.length(F.get(gaps, k)))


def _plain(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _found(rule: Rule, gaps: Column, matches: Column) -> Column:
    """The rule's spans with their scores."""

    def span(m: Column, k: Column, at: Column) -> Column:
        near = F.concat_ws(" ", _plain(F.right(F.get(gaps, k), F.lit(BEFORE))), _plain(F.left(F.get(gaps, k + 1), F.lit(AFTER))))
        moved = F.lit(rule.prior) + F.when(near.rlike(said(NEAR[rule.kind])), STEP).otherwise(0) - F.when(near.rlike(said(AGAINST)), STEP).otherwise(0)
        score = F.least(F.lit(100), F.greatest(F.lit(0), moved))
        return F.struct(F.lit(rule.kind).alias("kind"), at.alias("start"), (at + F.length(m)).alias("end"), score.alias("score"), F.lit(rule.base).alias("base"))

    each = F.transform(F.arrays_zip(matches.alias("m"), _starts(gaps, matches).alias("at")), lambda x, k: F.when(rule.valid(x["m"]), span(x["m"], k, x["at"])))
    kept = F.filter(each, lambda s: s.isNotNull() & (F.lit(True) if rule.base else s["score"] >= LEAST))
    return F.when(F.size(matches) > 0, kept).otherwise(F.array()).cast(_SPAN)


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, text, spans (kind, start, end, score, base) of each row of ``docs``, by kind in the order of ``KINDS``, then start."""
    rows = docs.select("doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = rows.select("*", *[F.regexp_extract_all(text, F.lit(r.pattern), F.lit(0)).alias(f"_m{k}") for k, r in enumerate(RULES)])
    # what stands between matches is asked for where there is one
    cut = cut.select("*", *[F.when(F.size(f"_m{k}") > 0, F.split(text, r.pattern, -1)).alias(f"_g{k}") for k, r in enumerate(RULES)])
    found = cut.select("doc_id", "text", *[_found(r, F.col(f"_g{k}"), F.col(f"_m{k}")).alias(f"_s{k}") for k, r in enumerate(RULES)])
    return found.select("doc_id", "text", _merged([F.col(f"_s{k}") for k in range(len(RULES))]).alias("spans"))


def _apart(added: Column, held: Column) -> Column:
    """The spans of ``added`` that meet none of ``held``."""
    return F.filter(added, lambda a: ~F.exists(held, lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"])))


def _of(found: Column, kind: str) -> Column:
    return F.filter(found, lambda s: s["kind"] == kind)


def _merged(by_rule: list[Column]) -> Column:
    """All spans of base rules, and of the others those that meet none of an earlier rule."""
    held = F.concat(*[s for s, r in zip(by_rule, RULES, strict=True) if r.base])
    for s, r in zip(by_rule, RULES, strict=True):
        if not r.base:
            held = F.concat(held, _apart(s, held))
    ordered = F.flatten(F.array(*[F.array_sort(_of(held, k)) for k in KINDS]))
    return F.when(reduce(lambda a, b: a + b, map(F.size, by_rule)) > 0, ordered).otherwise(F.array().cast(_SPAN))


def listed(found: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def figures(docs: DataFrame) -> DataFrame:
    """doc_id, counts and a digest of the base spans, all spans and their scores, for each row."""
    found = spans(docs).select("doc_id", "spans", F.filter("spans", lambda s: s["base"]).alias("base"))
    count = lambda kind: F.size(_of(F.col("base"), kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *map(count, KINDS[:4]),
        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of the texts as its kind in brackets; of spans that meet, the first names what they cover."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc_id"), "text")
    cut = "array<struct<since:bigint,upto:bigint,kind:string>>"
    by_place = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    add = lambda s, x: F.struct(x["end"].alias("at"), F.array_append(s["cuts"], F.struct(s["at"].alias("since"), x["start"].alias("upto"), x["kind"].alias("kind"))).alias("cuts"))
    wider = lambda s, x: F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["cuts"].alias("cuts"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(cut).alias("cuts"))
    merged = F.aggregate(by_place, start, lambda s, x: F.when(x["start"] >= s["at"], add(s, x)).otherwise(wider(s, x)))
    # four bytes a code point, so that a place is found without reading what stands before it
    found = spans(rows).select("doc_id", "text", merged.alias("m"), F.encode("text", "UTF-32").alias("points"))
    part = lambda since, size: F.decode(F.substring("points", (since * 4 + 1).cast("int"), (size * 4).cast("int")), "UTF-32")
    pieces = F.transform("m.cuts", lambda c: F.concat(part(c["since"], c["upto"] - c["since"]), F.lit("["), c["kind"], F.lit("]")))
    rest = part(F.col("m.at"), F.length("text") - F.col("m.at"))
    text = F.when(F.size("m.cuts") > 0, F.concat(F.array_join(pieces, ""), rest)).otherwise(F.col("text"))
    return found.select(*[(text if c == "text" else F.col(f"doc_id.`{c}`")).alias(c) for c in docs.columns])
