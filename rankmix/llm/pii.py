"""Personal data: expressions propose spans, checksums and rules confirm them,
words nearby adjust the score.  DataFrame functions only.

A text is cut by a kind's expression into gaps and matches; the running sum of
their lengths gives code-point offsets.  Proposals that fail their validator
(Luhn for cards, mod 97 for IBANs, part and digit limits for ip and phone) are
dropped without a retry.  An IBAN of a known country is proposed with that
country's length, so upper-case words and numbers that follow or precede it are
not taken into it; with other codes, or where that length does not end a word, the
longest run of groups is proposed.  Expressions use possessive forms that match what the
plain ones do but in linear time and without recursion, so texts of any length
are safe; a text that lacks a kind's trigger is not searched for it.

Nulls and empty texts have no spans; a null id is kept; repeated rows repeat;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMAIL, IP, CARD, PHONE, IBAN = "email", "ip", "card", "phone", "iban"
KINDS = (EMAIL, IP, CARD, PHONE, IBAN)        # order of kinds with one start
BASE_KINDS = KINDS[:4]

# Characters of an IBAN by country: the registry's, and those in use without an entry.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE IM ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU"}


def _iban() -> str:
    def body(length: int) -> str:
        groups, rest = divmod(length - 4, 4)
        return rf"(?:\x20?[A-Z0-9]{{4}}){{{groups}}}" + (rf"\x20?[A-Z0-9]{{{rest}}}" if rest else "")

    exact = "|".join(rf"(?:{'|'.join(names.split())})[0-9]{{2}}{body(n)}" for n, names in IBAN_LENGTHS.items())
    exact = rf"(?=[A-Z]{{2}}[0-9]{{2}})(?:{exact})\b"
    other = rf"(?!\x20{exact})\x20?[A-Z0-9]"          # no group of a run begins an IBAN of a known country
    return rf"\b(?:{exact}|[A-Z]{{2}}[0-9]{{2}}(?:{other}{{4}}){{2,7}}(?:{other}{{1,3}})?\b)"


_LOCAL = "A-Za-z0-9._%+-"
# A match may begin at a run's first character or where the last match ended;
# from inside a run it could not succeed where the run's start failed.
PATTERNS = {
    EMAIL: rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    IP: r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    CARD: r"[0-9](?:[\x20-]?[0-9])++",
    PHONE: r"\+[0-9][\x20().0-9-]+[0-9]",
    IBAN: _iban(),
}
TRIGGERS = {
    EMAIL: r"@[A-Za-z0-9-]",
    IP: r"[0-9]\.[0-9]",
    CARD: r"[0-9](?:[\x20-]?[0-9]){13}",
    PHONE: r"\+[0-9]",
    IBAN: r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}",
}
SCORES = {EMAIL: 0.9, IP: 0.6, CARD: 0.8, PHONE: 0.6, IBAN: 0.9}
BOOST, CONTEXT = 0.1, 40
# Words that speak for a kind, or against it, in the characters before or behind a span.
FOR = {
    EMAIL: r"(?i)\b(?:e-?mail|mail|contact|write)\b",
    IP: r"(?i)\b(?:ip|server|host|address|login|client)\b",
    CARD: r"(?i)\b(?:card|visa|mastercard|amex|credit|payment|carte|karte|tarjeta)\b",
    PHONE: r"(?i)\b(?:call|tel|phone|mobile|fax|ring|contact)\b",
    IBAN: r"(?i)\b(?:iban|bank|account|konto|compte|cuenta)\b",
}
AGAINST = {
    IP: r"(?i)\b(?:version|release|section|chapter)\b",
    CARD: r"(?i)\b(?:isbn|serial|order|tracking)\b",
}


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes Luhn's check."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(
        i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(places, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN (no blanks) leaves 1 modulo 97."""
    moved = F.concat(F.substr(iban, F.lit(5)), F.left(iban, F.lit(4)))
    value = lambda c: F.when(c <= "9", F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.split(moved, ""), F.lit(0),
                       lambda a, c: (a * F.when(c <= "9", 10).otherwise(100) + value(c)) % 97)
    return rest == 1


def confirmed(kind: str, m: Column) -> Column:
    if kind == EMAIL:
        return F.lit(True)
    if kind == IP:
        return ~m.rlike(r"(?:^|\.)0*(?:[1-9][0-9]{3}|[3-9][0-9]{2}|2[6-9][0-9]|25[6-9])")
    d = _digits(m)
    if kind == CARD:
        return F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False)
    if kind == PHONE:
        return F.length(d).between(10, 15)
    plain = F.replace(m, F.lit(" "), F.lit(""))
    return F.when(F.length(plain).between(15, 34), mod97(plain)).otherwise(False)


def _after(pairs: Column, rest: Column) -> Column:
    """For every match the CONTEXT characters behind it, found from the text's
    end backward; ``rest`` is what follows the last match."""
    start = F.struct(F.left(rest, F.lit(CONTEXT)).alias("near"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        near = F.left(F.concat(x["gap_head"], F.left(x["match"], F.lit(CONTEXT)), acc["near"]), F.lit(CONTEXT))
        return F.struct(near.alias("near"), F.concat(acc["out"], F.array(acc["near"])).alias("out"))

    return F.reverse(F.aggregate(F.reverse(pairs), start, step, lambda acc: acc["out"]))


def found(text: Column, kind: str) -> Column:
    """``array<struct<start, kind_no, end, score>>`` of one kind's spans.  The
    words that adjust the score are those in the CONTEXT characters before and
    in those behind the span, other spans' included."""
    pattern = F.lit(PATTERNS[kind])
    gaps = F.split(text, PATTERNS[kind], -1)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    pairs = F.zip_with(matches, F.slice(gaps, 1, F.size(matches)), lambda m, g: F.struct(
        F.char_length(g).alias("gap"), m.alias("match"), F.left(g, F.lit(CONTEXT)).alias("gap_head"),
        F.right(g, F.lit(CONTEXT)).alias("gap_tail"), confirmed(kind, m).alias("ok")))
    pairs = F.zip_with(pairs, _after(pairs, F.element_at(gaps, -1)), lambda x, after: F.struct(
        x["gap"].alias("gap"), x["match"].alias("match"), x["gap_tail"].alias("gap_tail"), x["ok"].alias("ok"), after.alias("after")))
    span_type = "array<struct<start:int,kind_no:int,end:int,score:double>>"
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("near"), F.array().cast(span_type).alias("spans"))

    def score(before, after):
        says = lambda words: before.rlike(words) | after.rlike(words)
        s = F.lit(SCORES[kind]) + F.when(says(FOR[kind]), BOOST).otherwise(0.0)
        if kind in AGAINST:
            s = s - F.when(says(AGAINST[kind]), 2 * BOOST).otherwise(0.0)
        return F.round(s, 3)

    def step(acc, x):
        at = acc["pos"] + x["gap"]
        end = at + F.char_length(x["match"])
        before = F.right(F.concat(acc["near"], x["gap_tail"]), F.lit(CONTEXT))
        span = F.struct(at.alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), end.alias("end"),
                        score(before, x["after"]).alias("score"))
        return F.struct(end.alias("pos"),
                        F.right(F.concat(before, F.right(x["match"], F.lit(CONTEXT))), F.lit(CONTEXT)).alias("near"),
                        F.when(x["ok"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate(pairs, start, step, lambda acc: acc["spans"])
    return F.when(text.rlike(TRIGGERS[kind]), spans).otherwise(F.array().cast(span_type))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind_no"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, n_iban, base, found)``: the
    base spans and all spans, each sorted by start, then kind."""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select(id_col, *[found(F.col("text"), k).alias(f"s_{k}") for k in KINDS])
    return rows.select(id_col, *[F.size(f"s_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
                       F.array_sort(F.concat(*[F.col(f"s_{k}") for k in BASE_KINDS])).alias("base"),
                       F.array_sort(F.concat(*[F.col(f"s_{k}") for k in KINDS])).alias("found"))


def pii_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts by base kind, the base spans' hash, all spans and, in their order,
    the spans' scores in percent."""
    rows = pii_spans(docs, id_col, text_col)
    return rows.select(id_col, "n_email", "n_ip", "n_card", "n_phone",
                       F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
                       _joined(F.col("found")).alias("spans"),
                       F.array_join(F.transform("found", lambda s: F.round(100 * s["score"]).cast("int").cast("string")), ",").alias(
                           "scores"))
