"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Only Spark's own functions run here. Kinds: email, ip, card (Luhn), phone, and iban (mod 97). A null
text counts as empty; an empty text has no spans; a text of any length is searched whole; an empty table gives an empty result; other columns of the input pass through, and
columns of the input with the names of added ones are replaced. Repeated rows each get their spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _spans, _store

BASE = ("email", "ip", "card", "phone")

#: Equal to the plain patterns in what they match; see _spans for the form.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: Characters of an IBAN, by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}


def _iban(length: int, countries: str) -> str:
    fours, rest = divmod(length - 4, 4)
    return rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{fours}}}" + (rf" ?[A-Z0-9]{{{rest}}}" if rest else "")


#: As long as the country's IBANs are, so that a word in capitals after one is not taken in.
IBAN = rf"(?<![A-Za-z0-9])(?:{'|'.join(_iban(n, c) for n, c in IBAN_LENGTHS.items())})(?![A-Za-z0-9])"

_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

#: Words that, up to _spans.NEAR characters before or after a span, speak for its kind.
CONTEXT = {
    "email": "e-?mail|mail|contact|write|correo|courriel",
    "ip": "ip|host|server|address|addr|login",
    "card": "card|visa|credit|debit|payment|mastercard|karte|carte|tarjeta",
    "phone": "phone|call|tel|telephone|mobile|fax|cell|whatsapp",
    "iban": "iban|account|bank|konto|compte|cuenta|transfer",
}


def context(kind: str) -> str:
    """A pattern of the kind's words as whole words."""
    return f"(?i)(^|[^A-Za-z0-9_])({CONTEXT[kind]})([^A-Za-z0-9_]|$)"


#: What a span scores by its form (with its checksum, where it has one), and what a context word adds.
FORM, NEARBY = {"email": 0.8, "ip": 0.5, "card": 0.8, "phone": 0.5, "iban": 0.9}, 0.2


def luhn(hit: Column) -> Column:
    """14 to 19 digits whose Luhn sum is a multiple of ten."""
    digits = F.reverse(F.regexp_replace(hit, "[ -]", ""))
    value = F.filter(F.split(digits, ""), lambda c: c != "")
    doubled = F.transform(value, lambda c, i: F.when(i % 2 == 0, c.cast("int")).when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2))
    total = F.aggregate(doubled, F.lit(0), lambda a, x: a + x)
    return F.when(F.char_length(digits).between(14, 19), total % 10 == 0).otherwise(False)


def mod97(hit: Column) -> Column:
    """An IBAN whose rearranged number leaves 1 when divided by 97."""
    bare = F.regexp_replace(hit, " ", "")
    turned = F.filter(F.split(F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4)), ""), lambda c: c != "")

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

    return F.aggregate(turned, F.lit(0), step) == 1


def _score(kind: str):
    return lambda hit, around: F.lit(FORM[kind]) + F.when(around.rlike(context(kind)), NEARBY).otherwise(0.0)


def found(text: Column) -> Column:
    """All spans of a text, by start and then kind, with scores from 0.5 to 1.1."""
    text = F.coalesce(text, F.lit(""))
    return F.array_sort(
        F.concat(
            _spans.spans(text, "email", 1, EMAIL, lambda h: h.isNotNull(), _score("email"), "@"),
            _spans.spans(text, "ip", 2, IP, lambda h: h.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), _score("ip")),
            _spans.spans(text, "card", 3, CARD, lambda h: F.when(F.char_length(h) >= 14, luhn(h)).otherwise(False), _score("card")),
            _spans.spans(text, "phone", 4, PHONE, lambda h: F.char_length(F.regexp_replace(h, "[^0-9]", "")).between(10, 15), _score("phone"), "+"),
            _spans.spans(text, "iban", 5, IBAN, mod97, _score("iban")),
        )
    )


def detect(docs: DataFrame, text: str = "text", least: float = 0.0) -> DataFrame:
    """docs with the column pii: spans (start, rank, end, kind, score) of at least that score."""
    got = docs.withColumn("pii", found(F.col(text)))
    return got if least <= 0 else got.withColumn("pii", F.filter("pii", lambda s: s["score"] >= least))


def redact(docs: DataFrame, text: str = "text", least: float = 0.0) -> DataFrame:
    """docs, with each span of personal data in the text replaced by its kind in brackets. A null text stays null."""
    names = docs.columns
    docs, clash = _store.aside(docs, ["pii"])
    seen = detect(docs, text, least)
    return _store.back(seen.withColumn(text, F.when(F.col(text).isNotNull(), _spans.masked(F.col(text), F.col("pii")))), clash, names)
